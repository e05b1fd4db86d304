import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import near_dedup
from millrace.llm.components import components
from millrace.llm.near_dedup import Near, drop_near_copies, links_of, near_groups, signatures, super_minhash


def shingles(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [i for i in sorted(sets) if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(docs, k):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = near_groups(docs, Near(words=k)).collect()
    assert len(found) == len(rows)
    want = brute([r for r in rows if r[0] is not None], k)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]], r


def test_family_of_near_copies_without_a_centre(spark):
    """A chain: neighbours are linked, others mostly aren't; and copies that are close to a text without being linked to it."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = [word() for _ in range(200)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(text)))
        for _ in range(7):
            text[rng.randrange(200)] = word()
    base = [word() for _ in range(150)]
    for i in range(100, 180):
        copy = list(base)
        for _ in range(rng.randrange(0, 16)):
            copy[rng.randrange(150)] = word()
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(docs, Near(words=2)).collect()} == want


def test_empty_table(none):
    assert near_groups(none).count() == 0
    assert drop_near_copies(none).count() == 0


def test_drop_near_copies(docs):
    stay = drop_near_copies(docs, Near(words=2))
    assert stay.columns == docs.columns
    ids = {r["doc_id"] for r in stay.collect()}
    assert {1, 2, 3, 10} & ids == set() and {0, 4, 5, 6, 9, 11, None} <= ids


def test_signature_estimates_similarity_and_stops_early_without_change():
    rng = np.random.default_rng(1)
    for size, share in ((40, 0.8), (400, 0.6), (5000, 0.9)):
        common = rng.integers(0, 2**63, int(size * share), dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, size - len(common), dtype=np.uint64)]) for _ in range(2))
        exact = len(common) / (2 * size - len(common))
        guess = (super_minhash(a, 256) == super_minhash(b, 256)).mean()
        assert abs(guess - exact) < 0.12
    assert (super_minhash(a, 64) == super_minhash(rng.permutation(a), 64)).all()
    one = super_minhash(a[:1], 32)
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(32))  # one element visits each slot once


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1400)] + [(2000, k) for k in range(2001, 2300)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert found == {x: root(x) for x in up if root(x) != x}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    rows = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    assert links_of(rows, signatures(rows, Near(words=2)), Near(words=2)).count() == 0


def test_columns_with_the_operator_s_names_come_back(docs):
    names = ["_gone", "id", "bucket", "elements", "component", "set_key", "a", "b"]
    wide = docs.withColumns({x: F.concat(F.lit(x), F.col("n").cast("string")) for x in names})
    stay = drop_near_copies(wide, Near(words=2))
    assert stay.columns == wide.columns
    assert sorted(r["n"] for r in stay.collect()) == sorted(r["n"] for r in drop_near_copies(docs, Near(words=2)).collect())
    assert all(r[x] == f"{x}{r['n']}" for r in stay.collect() for x in names)


@pytest.mark.parametrize("block,elements", [(3, 1 << 19), (256, 500)])
def test_blocks_of_any_size_lose_no_link(spark, monkeypatch, block, elements):
    """Copies close to a text and to some others: every bucket is dealt into many blocks, by rows or by elements."""
    monkeypatch.setattr(near_dedup, "QUERY_BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK", 2 * block)
    monkeypatch.setattr(near_dedup, "ELEMENTS", elements)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(150)], []
    for i in range(70):
        copy = list(base)
        for _ in range(rng.randrange(0, 18)):
            copy[rng.randrange(150)] = word()
        rows.append((i, " ".join(copy)))
    found = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), Near(words=2)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == brute(rows, 2)


def test_buckets_of_the_same_members_are_compared_once(spark):
    rows = [(b, k, 10 + k) for b in (1, 2) for k in (1, 2, 3)] + [(3, 1, 11), (3, 2, 12), (4, 1, 11), (4, 3, 13), (5, 2, 12), (5, 3, 13)]
    shared = spark.createDataFrame(rows, "bucket long, id long, elements long")
    comps = spark.createDataFrame([(2, 2), (3, 2)], "id long, component long")
    found = {}
    for r in near_dedup._mixed(shared, comps).collect():
        found.setdefault(r["bucket"], set()).add((r["id"], r["c"], r["top"]))
    assert found == {1: {(1, 1, False), (2, 2, True), (3, 2, True)}, 3: {(1, 1, False), (2, 2, True)}, 4: {(1, 1, False), (3, 2, True)}}
