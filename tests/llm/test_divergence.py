"""Source divergence against sums over every term, with hard rows, and its run-length columns against dense ones."""

from collections import Counter, defaultdict
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm.divergence import divergence, runs_of, source_divergence

COLUMN = st.lists(st.sampled_from([0, 0, 0, 1, 2]), min_size=1, max_size=40)


@given(COLUMN)
def test_runs(column):
    at = np.flatnonzero(column)
    start, value = runs_of(at, np.array(column)[at], len(column))
    assert np.repeat(value, np.diff(start, append=len(column))).tolist() == column
    assert all(value[1:] != value[:-1])


@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3)), min_size=1, max_size=30))
def test_pieces_between_bounds(both):
    p, q = (np.array(x, dtype=np.int64) * 1000 for x in zip(*both, strict=True))
    runs = [(np.flatnonzero(np.append(True, x[1:] != x[:-1])), x[np.append(True, x[1:] != x[:-1])]) for x in (p, q)]
    assert divergence(*runs, len(p)) == int(((p - q) ** 2 // (p + q)).sum())


def plain(rows, least, top):
    capitals = {i: i + 32 for i in range(65, 91)}
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, words = lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(capitals))
        groups.add((lang, source))
        n[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [w for w, k in docs[lang].items() if k >= least]
        share = lambda count, c, kept=kept: 1 + 1_000_000_000 * (c + 2) // (sum(count[w] for w in kept) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        mine, whole = n[lang, source], sum((n[g] for g in groups if g[0] == lang), Counter())
        pairs = [(o[1], sum(f(share(mine, mine[w]), share(n[o], n[o][w])) for w in kept)) for o in groups if o[0] == lang and o[1] != source]
        terms = [(w, f(share(mine, mine[w]), share(whole, whole[w]))) for w in kept if mine[w] and share(mine, mine[w]) > share(whole, whole[w])]
        for part, found in (("pair", pairs), ("term", terms)):
            found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def rows_of(docs, **how):
    return sorted(tuple(r) for r in source_divergence(docs, **how).collect())


@pytest.mark.parametrize("entries", [3, 1 << 19])
def test_hard_rows(spark, docs, entries):
    """Nulls, blanks, repeated rows and clashing columns; tiles of a few counts give what one tile gives."""
    docs = docs.unionByName(docs.withColumn("lang", docs["source"]).withColumn("source", docs["key"]))
    assert rows_of(docs, least=2, top=4, entries=entries) == plain([(r["lang"], r["source"], r["text"]) for r in docs.collect()], 2, 4)


def test_groups_without_terms(spark):
    docs = spark.createDataFrame([("en", "a", None), ("en", "b", "1 2"), ("en", None, "x"), ("fr", "a", "x")], "lang string, source string, text string")
    assert rows_of(docs) == plain([tuple(r) for r in docs.collect()], 10, 10)
    assert {(r[1], r[3], r[4]) for r in rows_of(docs)} == {(a, b, 0) for a in ("", "a", "b") for b in ("", "a", "b") if a != b}


def test_empty(none):
    assert rows_of(none) == []
