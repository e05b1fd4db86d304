"""Language identification: n-grams, kernel and regression against plain sets and dual solutions, held-out accuracy, hard rows."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import language_id as l
from millrace.llm.queries import queries

TEXTS = st.lists(st.text(st.sampled_from("aBc \n.1éñ漢"), max_size=20), min_size=1, max_size=7)


def plain_grams(text):
    low = "".join(ch if ch.isalpha() or ord(ch) > 127 else " " for ch in text.lower())
    raw = " ".join(low.split(" ")).encode()
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    raw = b" " + raw.removeprefix(b" ") + b" "
    return {int.from_bytes(raw[k : k + n], "little") for n in range(1, 5) for k in range(len(raw) - n + 1)}


@given(TEXTS)
def test_grams(texts):
    for t in texts:
        assert set(l.grams_of(t).tolist()) == plain_grams(t)


@given(TEXTS, TEXTS)
def test_kernel(texts, landmarks):
    """Presence of a batch, its neighbours beside it, and the kernel by sets."""
    marks = l.Landmarks(landmarks)
    known = set().union(*map(plain_grams, landmarks))
    has = marks.grams.presence(*l.normal(pa.array(texts)))
    assert has.sum(axis=1).tolist() == [len(plain_grams(t) & known) for t in texts]
    for row, t in zip(marks.kernel(has), texts, strict=True):
        x = plain_grams(t) & known
        expected = [len(x & plain_grams(z)) / max(1, np.sqrt(len(x) * len(plain_grams(z)))) for z in landmarks]
        assert np.allclose(row, expected, atol=1e-6)


def test_long_text_is_read_in_windows(monkeypatch):
    monkeypatch.setattr(l, "WINDOW", 7)
    text = "The quick brown fox jumps over the lazy dog"
    marks = l.Landmarks([text[:20], text])
    assert marks.grams.presence(*l.normal(pa.array([text, "x"])))[0].sum() == len(plain_grams(text))


def test_slots_taken_twice(monkeypatch):
    monkeypatch.setattr(l, "SLOT_BITS", 3)
    known = np.unique(np.random.default_rng(1).integers(1, 1 << 32, 60, dtype=np.uint32))
    table = l.Grams(known)
    at, number = table.find(np.append(known, [np.uint32(5)]))
    assert len(table.levels) > 1 and sorted(zip(at.tolist(), number.tolist(), strict=True)) == [(k, k) for k in range(len(known))]


def test_regression_is_kernel_ridge_regression():
    """With every training text a landmark, folded weights give the dual solution of ridge regression on centred features."""
    texts = ["the cat sat", "on the mat", "le chat noir", "sur la table", "der hund lag", "auf dem bett"]
    marks = l.Landmarks(texts)
    kernel = marks.kernel(marks.has.T).astype(float)
    target = np.repeat(np.eye(3), 2, axis=0)
    weights, constants = l.fit(marks, kernel, target, ridge=0.01)
    n = len(texts)
    centre = np.eye(n) - 1 / n
    dual = np.linalg.solve(centre @ kernel @ centre + 0.01 * n * np.eye(n), target - target.mean(axis=0))
    expected = centre @ kernel @ centre @ dual + target.mean(axis=0)
    has = marks.has.T
    assert np.allclose(has @ weights / np.sqrt(has.sum(axis=1))[:, None] + constants, expected, atol=1e-3)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    found = queries()["op12_language_id"](spark, sf_dir).toPandas()
    out = found[found["held_out"]]
    assert len(found) == len(docs) and (out["lang_pred"] == docs[out["doc_id"]].to_numpy()).mean() > 0.97
    assert found["score"].between(0, 1).all()


def test_only_the_text_decides(spark, sf_dir):
    """Other sources, ids and languages of held-out documents change no prediction; nor does dealing rows anew."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [r["doc_id"] for r in docs.select("doc_id").collect() if l.held_out(r["doc_id"], 3, 1)]
    hidden = docs["doc_id"].isin(out)
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(hidden, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string")).repartition(7)
    a, b = (l.identify(x).toPandas().set_index("doc_id").sort_index() for x in (docs, other))
    assert (a["lang_pred"] == b["lang_pred"]).all() and np.allclose(a["score"], b["score"], atol=1e-4)


def test_hard_rows(docs):
    found = l.identify(docs).collect()
    assert len(found) == docs.count()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in found:
        none = not any(map(str.isalpha, text[r["doc_id"]] or ""))
        assert r["lang_pred"] == ("und" if none else "en") and (r["score"] == 0 or not none)
        assert r["held_out"] == l.held_out(r["doc_id"], 3, 1)


@pytest.mark.parametrize("lang", [None, "en"])
def test_nothing_to_learn_from(spark, lang):
    docs = spark.createDataFrame([(1, "some words", lang, "s"), (None, "more", "fr", None)], "doc_id long, text string, lang string, source string")
    held = [k for k in range(50) if l.held_out(k, 3, 1)][0]
    found = l.identify(docs.where("doc_id is null").unionByName(spark.createDataFrame([(held, "some words", lang, "s")], docs.schema))).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}


def test_empty(none):
    assert l.identify(none).count() == 0
