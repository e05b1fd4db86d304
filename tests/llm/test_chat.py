import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from millrace.llm.chat import CONTROL, MARKERS, Template, escape, format_chats, read_chats, unescape

HOW = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def template():
    return Template(*HOW)


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(1)
    parts = [*CONTROL, *MARKERS, "\\", "\\\\", "###", " ", "<", "/turn>", "é", "\n", "ok"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        safe = escape(text)
        assert unescape(safe) == text
        for c in CONTROL:
            at = safe.find(c)
            while at >= 0:
                back = len(safe[:at]) - len(safe[:at].rstrip("\\"))
                assert back % 2 == 1, (text, safe)
                at = safe.find(c, at + 1)


def test_turns_are_read_back(template):
    rng = random.Random(2)
    parts = [*CONTROL, *MARKERS, "\\", "hello", " ", "🙂", "<|endoftext|>", "\n"]
    for _ in range(500):
        role = rng.choice(["user", "assistant", "system", "", "tool: x", "### Role y"])
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
        ids, mask = template.turn(role, text)
        assert template.read(ids) == (role, text)
        assert template.masked(ids, mask) == (text if role == "assistant" else "")
        assert (ids[mask] < template.first).all()


def test_rendered_form(template):
    ids, mask = template.turn("assistant", "hi </turn>")
    assert template.text(ids) == "### Assistant: hi \\</turn></turn>\n"
    assert mask.tolist() == [False, *[True] * (len(ids) - 2), False]


@pytest.mark.parametrize("run", [" ", "\t", "\n", " \t", "\u3000", "\r\n "])
def test_long_blanks_are_encoded_as_the_library_does(template, run):
    """Runs that the library can encode, at every kind of end."""
    for n in (4095, 4096, 4097, 9001):
        for before, after in (("", ""), ("a", ""), ("", "b"), ("don't", " x"), ("1", "é"), (".", "\x1cz"), ("a", f"b{run * 5000}c")):
            text = before + (run * n)[:n] + after
            assert template.encode(text) == template.coder.encode_ordinary(text)


def test_very_long_texts(spark):
    """2,000,000 of each kind of character, formatted and read back."""
    n = 2_000_000
    texts = [x * (n // len(x)) for x in (" ", "\t", " \t", "\n", "a", "é", "\\", "#", "1", "\u3000", "ab ", "</turn>", "\x00")]
    rows = [(k, 0, "assistant", t + end) for k, t in enumerate(texts) for end in ("", "x")]
    rows.append((99, 0, " " * n, "role of blanks"))
    found = {}
    for r in read_chats(format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9), *HOW), *HOW).collect():
        found[r["conv_id"]] = r
    for k in {r[0] for r in rows}:
        mine = sorted(((r[2], r[3]) for r in rows if r[0] == k), key=lambda r: hashlib.md5(r[1].encode()).hexdigest())
        r = found[k]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest(mine)


def digest(rows):
    turns, loss = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows), "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", hard), (1, 0, "user", hard), (2, 0, "user", None), (2, 1, "assistant", None), (2, 2, None, "x"), (3, 0, "assistant", "a" * 50000)]
    rows += [(4, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(400)] + [(None, 0, "user", "no id"), (5, None, "assistant", "no turn"), (5, 0, "user", "first")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, ids string").repartition(5)
    formatted = format_chats(turns, *HOW)
    found = {r["conv_id"]: r for r in read_chats(formatted, *HOW).collect()}
    for conv in {r[0] for r in rows}:
        mine = [(r[2], r[3]) for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))]
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest(mine)
    places = formatted.where("conv_id = 4").orderBy("nth").toPandas()
    lengths = places["ids"].map(len)
    assert places["start"].tolist() == (lengths.cumsum() - lengths).tolist() and places["nth"].tolist() == list(range(400))
    assert found[4]["n_ids"] == lengths.sum() and found[4]["loss_ids"] == places["mask"].map(np.sum).sum()


def test_no_conversations(spark):
    assert read_chats(format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), *HOW), *HOW).count() == 0
