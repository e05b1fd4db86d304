"""Collocations against plain counts, whatever tasks hold; hashes, tiles and codes by themselves."""

from collections import Counter, defaultdict
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import collocations as c


def plain(rows, least=10, share=50, top=2000):
    found = defaultdict(lambda: [Counter(), Counter(), Counter()])
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                found[lang or "und"][n - 1].update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    out = []
    for lang, counts in found.items():
        f = counts[0] | counts[1] | counts[2]
        phrases = [p for p in (*counts[1], *counts[2]) if f[p] >= least]
        longer = [p for p in phrases if len(p) == 3]
        gone = {q for p in longer for q in (p[:2], p[1:]) if 100 * f[p] >= share * f[q]}
        kept = []
        for p in phrases:
            if p not in gone:
                score, k = min((1_000_000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(counts[0].values())
        out += [(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def rows_of(docs, **how):
    return sorted(tuple(r) for r in c.collocations(docs, **how).collect())


@pytest.mark.parametrize("held", [(c.HELD_WORDS, c.HELD_PAIRS), (6, c.HELD_PAIRS), (c.HELD_WORDS, 5), (0, 0)])
def test_hard_rows(docs, held):
    """What tasks hold decides nothing: with few or no ids, bitmaps and hashed codes give the same rows."""
    docs = docs.withColumn("lang", F.when(F.col("n") % 3 > 0, F.col("lang")))
    expected = plain([(r["lang"], r["text"]) for r in docs.collect()], least=3)
    assert len(expected) > 30
    assert rows_of(docs, least=3, held_words=held[0], held_pairs=held[1]) == expected


def test_real_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = plain([(r["lang"], r["text"]) for r in docs.collect()], top=50)
    assert rows_of(docs.repartition(5), top=50, held_words=300, held_pairs=100) == expected == rows_of(docs, top=50)


def test_ties_and_cuts(spark):
    """Both cuts alike: the first counts; a pair at exactly half of its occurrences goes, one below stays."""
    texts = ["a b c"] * 10 + ["b c"] * 10 + ["a b"] * 11 + ["x y"] * 9
    docs = spark.createDataFrame([(None, t) for t in texts], "lang string, text string")
    assert rows_of(docs) == plain([(None, t) for t in texts])
    assert {r[2] for r in rows_of(docs)} == {"a b c", "a b"}


def test_empty(none):
    assert rows_of(none) == []


def test_hash_is_sparks(spark):
    rows = spark.createDataFrame([("en", "the"), ("", "é漢"), ("und", "x" * 100)], "lang string, word string")
    for seed in (0, 7):
        assert [r[0] for r in rows.select(c.hash_column(seed)).collect()] == [c.word_hash(r["lang"], r["word"].encode(), seed) for r in rows.collect()]


def test_seed_changes_on_collision(spark, monkeypatch):
    """Words that share a hash and are frequent together are told apart by another seed."""
    real = c.hash_column
    monkeypatch.setattr(c, "hash_column", lambda seed: F.lit(1).cast("long") if seed == 0 else real(seed))
    words = spark.createDataFrame([("en", "a", 6), ("en", "b", 4)], "lang string, word string, n long")
    assert c._seed(words, 10) == 1 and c._seed(words, 11) == 0


PAIRS = st.lists(st.tuples(st.integers(0, 5000), st.integers(0, 5000)), max_size=60)


@given(st.lists(PAIRS, max_size=6))
def test_tiles(batches):
    """Dense or sparse, given out early or at the end: the counts are the same."""
    tiles, found = c.Tiles(gathered=20, distinct=30, worth=3), Counter()
    for batch in batches:
        x, y = (np.array([p[k] for p in batch], dtype=np.int64) for k in (0, 1))
        for a, b, n in tiles.add(x, y):
            found.update(dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)))
    for a, b, n in tiles.rest():
        for p, k in zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True):
            found[p] += k
    assert found == Counter(p for batch in batches for p in batch)


@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), max_size=40))
def test_apart(pairs):
    apart, found = c.Apart(distinct=7), Counter()
    for p in pairs:
        for x, y, n in apart.add(np.array([p[0]]), np.array([p[1]])):
            found.update(dict(zip(zip(x.tolist(), y.tolist(), strict=True), n.tolist(), strict=True)))
    for x, y, n in apart.rest():
        for p, k in zip(zip(x.tolist(), y.tolist(), strict=True), n.tolist(), strict=True):
            found[p] += k
    assert found == Counter(pairs)


def test_large_products(spark):
    """l * r passes 64 bits."""
    row = spark.createDataFrame([(10**12, 10**13, 10**13)], "a long, l long, r long").select(c._score("a", "l", "r")).first()
    assert row[0] == 1_000_000 * 10**24 // 10**26


def test_pair_codes():
    keys = np.array([1 << c.WORD_BITS | 2, 3 << c.WORD_BITS | 1])
    pairs = c.Pairs(keys, np.array([1, 0], dtype=np.int32), np.array([3, 1]), np.array([1, 2]), None)
    assert pairs.codes(np.array([1, 3, 2, -1]), np.array([2, 1, 2, 1])).tolist() == [1, 0, -1, -1]
    assert len(c.split(pa.array([None, ""], pa.string()), c.PIECES)) == 0
