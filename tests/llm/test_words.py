"""The word splitter against regular expressions, over columns of odd texts."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm.collocations import PIECES
from millrace.llm.divergence import LETTERS
from millrace.llm.words import heaviest, split, sums_by

CAPITALS = {i: i + 32 for i in range(65, 91)}
TEXTS = st.lists(st.none() | st.text(st.sampled_from("aB. \t\n;\x0b\x1c\x00é漢İ🙂"), max_size=25), max_size=8)


@given(TEXTS, st.integers(0, 3))
def test_pieces_and_words(texts, skip):
    column = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    found, pieces = [], []
    for k, text in enumerate(column.to_pylist()):
        for p, piece in enumerate(re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(CAPITALS))):
            for word in re.findall(r"[^\x20\x09]+", piece):
                found.append((k, word))
                pieces.append((k, p))
    words = split(column, PIECES)
    assert [(int(t), words.distinct[int(p)].as_py().decode()) for p, t in zip(words.place, words.text, strict=True)] == found
    assert [a == b for a, b in zip(pieces, pieces[1:], strict=False)] == list(words.piece[1:] == words.piece[:-1])


@given(TEXTS)
def test_letters(texts):
    words = split(pa.array(texts, pa.string()), LETTERS)
    expected = [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(CAPITALS))]
    assert [(int(t), words.distinct[int(p)].as_py().decode()) for p, t in zip(words.place, words.text, strict=True)] == expected


def test_sums_by():
    keys, a, b = sums_by(np.array([5, 1, 5]), np.array([1, 2, 3]), np.array([10, 20, 30]))
    assert keys.tolist() == [1, 5] and a.tolist() == [2, 4] and b.tolist() == [20, 40]
    assert all(len(x) == 0 for x in sums_by(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))


def test_heaviest(spark):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate([1, 1, 1, 2, 5, 1 << 40, (1 << 40) + 1])], "k int, n long")
    assert sorted(r["k"] for r in heaviest(rows, "n", 4).collect()) == [3, 4, 5, 6]
    assert sorted(r["k"] for r in heaviest(rows, "n", 6).collect()) == [3, 4, 5, 6]
    assert heaviest(rows.where("n = 1"), "n", 2).count() == 0
    assert heaviest(rows, "n", 7).count() == 7
