import math
import random

import numpy as np
import pytest

from millrace.llm.quality import ABSTAIN, BAD, GOOD, LABELLERS, Scorer, classify, code_of, document_features, fit_labels, fit_scorer, keep_good, votes, word_features


def test_label_model_finds_accuracies():
    """Votes drawn from known accuracies; a labeller that often abstains, and one that is hardly better than chance."""
    rng = np.random.default_rng(1)
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.55, 0.9])
    speaks = np.array([1, 1, 0.9, 1, 0.3, 1, 0.8])
    truth = rng.random(20000) < 0.8
    cast = np.where(rng.random((20000, 7)) < right, truth[:, None], ~truth[:, None]).astype(int)
    cast[rng.random((20000, 7)) >= speaks] = ABSTAIN
    patterns, which, counts = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    posterior, model = fit_labels(patterns, counts)
    assert abs(model["share"] - 0.8) < 0.02
    assert np.abs(np.array(list(model["accuracy"].values())) - right).max() < 0.03
    assert ((posterior[which.ravel()] > 0.5) == truth).mean() > 0.97


def test_votes():
    prose = "the cat sat on the mat and it was warm in the old house by the sea where we met " * 2
    assert set(votes(prose)) <= {GOOD, ABSTAIN}
    assert votes(prose.upper())[1] == BAD
    assert votes(" ".join(w + "###" for w in prose.split()))[0] == BAD
    assert votes("again " * 60)[2] == BAD
    assert votes(None) == votes("") == votes(" \n") == [BAD] * len(LABELLERS)
    assert 0 <= code_of(prose) < 3 ** len(LABELLERS)


def test_scorer_learns_soft_targets():
    rng = np.random.default_rng(2)
    rows = [{int(f): 0.25 for f in rng.choice(50, 4, replace=False)} for _ in range(400)]
    target = np.array([0.9 if 7 in r else 0.1 for r in rows])
    weights, bias = fit_scorer(rows, target)
    p = np.array([1 / (1 + np.exp(-(bias + sum(weights[f] * x for f, x in r.items())))) for r in rows])
    assert ((p > 0.5) == (target > 0.5)).mean() > 0.97


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return classify(docs).join(labels, "doc_id").toPandas()


def test_held_out_accuracy(judged):
    """Labels are never read by the classifier."""
    assert (judged["kept"] == (judged["quality"] == 1)).mean() > 0.95
    assert judged[judged["quality"] == 1]["kept"].mean() > 0.99
    assert judged[judged["quality"] == 0]["kept"].mean() < 0.2


def test_hard_rows(docs, none):
    found = classify(docs).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    assert not by_id[4]["kept"] and not by_id[5]["kept"] and not by_id[6]["kept"]
    assert by_id[0]["score"] == by_id[1]["score"]
    assert classify(none).count() == 0 and keep_good(none).count() == 0


def test_filter_keeps_columns_and_rows(docs):
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    want = sorted(str(r["doc_id"]) for r in classify(docs).where("kept").collect())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


def test_sample_is_bounded(docs):
    assert len(classify(docs, sample=3).collect()) == docs.count()


def plain_labels(patterns, counts, rounds=200):
    """Expectation-maximisation in plain loops: two classes, independent votes, half a vote added to each count."""
    posterior = [(0.9, 0.5, 0.1)[min(sum(v == BAD for v in p), 2)] for p in patterns]
    for _ in range(rounds):
        total = sum(counts)
        share = sum(c * q for c, q in zip(counts, posterior)) / total
        odds = [math.log(share / (1 - share))] * len(patterns)
        for j in range(len(patterns[0])):
            cast = {(y, v): 0.5 for y in (0, 1) for v in (BAD, GOOD)}
            for p, c, q in zip(patterns, counts, posterior):
                if p[j] != ABSTAIN:
                    cast[0, p[j]] += c * (1 - q)
                    cast[1, p[j]] += c * q
            for k, p in enumerate(patterns):
                if p[j] != ABSTAIN:
                    odds[k] += sum(sign * math.log(cast[y, p[j]] / (cast[y, BAD] + cast[y, GOOD])) for y, sign in ((1, 1), (0, -1)))
        posterior = [1 / (1 + math.exp(-max(-50, min(50, x)))) for x in odds]
    return posterior


def test_label_model_against_plain_loops():
    rng = random.Random(4)
    table = {}
    for _ in range(3000):
        good = rng.random() < 0.7
        votes = tuple(ABSTAIN if rng.random() < 0.2 else int(good) if rng.random() < 0.75 + 0.03 * j else 1 - int(good) for j in range(7))
        table[votes] = table.get(votes, 0) + 1
    patterns, counts = list(table), list(table.values())
    found, model = fit_labels(np.array(patterns), np.array(counts))
    assert np.allclose(found, plain_labels(patterns, counts), atol=1e-6)
    assert abs(model["share"] - 0.7) < 0.05


def test_scorer_against_plain_loops():
    texts = ["the sun is warm and the sea is blue.", "### $$$ ABC ABC ABC ABC", "a b c a b c", "der Hund und die Katze", "x" * 90, "The Of And 12 12 12"]
    target = [1.0, 0.0, 0.4, 0.9, 0.1, 0.5]
    features = [document_features(t) for t in texts]
    weights, bias = fit_scorer(features, np.array(target), epochs=3)
    w, b, squares, square, order = {}, 0.0, {}, 1e-6, np.random.default_rng(1)
    for _ in range(3):
        for k in order.permutation(len(texts)):
            p = 1 / (1 + math.exp(-(sum(w.get(f, 0.0) * x for f, x in features[k].items()) + b)))
            for f, x in features[k].items():
                step = (p - target[k]) * x + 1e-5 * w.get(f, 0.0)
                squares[f] = squares.get(f, 1e-6) + step**2
                w[f] = w.get(f, 0.0) - 0.5 * step / math.sqrt(squares[f])
            square += (p - target[k]) ** 2
            b -= 0.5 * (p - target[k]) / math.sqrt(square)
    assert abs(bias - b) < 1e-9 and all(abs(weights[f] - x) < 1e-9 for f, x in w.items())
    scorer = Scorer(weights, bias)
    for t, f in zip(texts, features):
        assert abs(scorer(t) - 1 / (1 + math.exp(-(sum(w.get(k, 0.0) * x for k, x in f.items()) + b)))) < 1e-6


def test_other_scripts_and_long_words():
    """The list of function words says nothing of other scripts, and a word's shape is that of all of it."""
    at = LABELLERS.index("function words")
    assert votes("это простой текст на другом языке " * 10)[at] == ABSTAIN and votes("xy zz qq ww " * 10)[at] == BAD
    long = b"aB" * 100
    assert word_features(long + b"1") != word_features(long + b"-")
    assert word_features(b"a" * 500 + b"7")[0] == word_features(b"a7")[0]


def test_classify_as_a_whole(spark, sf_dir):
    """Votes, label model, training and scores of a table by plain loops over its rows."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ordered = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h")).orderBy("h", "doc_id").collect()
    codes = np.array([code_of(r["text"]) for r in ordered])
    known, counts = np.unique(codes, return_counts=True)
    posterior = dict(zip(known.tolist(), fit_labels(known[:, None] // 3 ** np.arange(len(LABELLERS)) % 3, counts)[0], strict=True))
    features = [{k: float(np.float32(x)) for k, x in document_features(r["text"]).items()} for r in ordered]
    scorer = Scorer(*fit_scorer(features, np.array([posterior[c] for c in codes.tolist()])))
    found = {r["doc_id"]: r for r in classify(docs).collect()}
    assert len(found) == len(ordered)
    for r, code in zip(ordered, codes.tolist(), strict=True):
        f = found[r["doc_id"]]
        assert f["votes"] == code and abs(f["posterior"] - posterior[code]) < 1e-12
        assert abs(f["score"] - scorer(r["text"])) < 1e-9 and f["kept"] == (f["score"] >= 0.3)
    kept = {i for i, r in found.items() if r["kept"]}
    assert {r["doc_id"] for r in keep_good(docs).collect()} == kept and 0 < len(kept) < len(found)
