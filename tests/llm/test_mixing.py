import re

from pyspark.sql import functions as F

from millrace.llm.mixing import first_words, mix_documents, mix_sources


def fill(sizes, weights, budget, most):
    """Shares by weight, capped; the excess shared again until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), budget
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs, found):
    source = {r["n"]: r["source"] for r in docs.collect()} if "n" in docs.columns else {}
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    want = fill(sizes, (5, 2, 1), 1.5 * sum(sizes.values()), 2)
    taken = {}
    by_size = {}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        key = next(s for s in want if sizes[s] == r["source_size"] and abs(want[s] - r["target"]) < 1e-6 * max(1, want[s]))
        taken[key] = taken.get(key, 0) + r["taken"]
        by_size[key] = by_size.get(key, 0) + r["size"]
    assert by_size == sizes and len(found) == docs.count()
    for s in want:
        assert abs(taken[s] - want[s]) <= 1, (s, taken[s], want[s])
    return source


def test_targets_and_taken_words(docs):
    check(docs, mix_sources(docs, seed=3).collect())


def test_whole_table_and_reruns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = mix_sources(docs, seed=5)
    check(docs, first.collect())
    again = {(r["doc_id"], r["taken"]) for r in mix_sources(docs.repartition(7), seed=5).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in first.collect()}
    assert again != {(r["doc_id"], r["taken"]) for r in mix_sources(docs, seed=6).collect()}


def test_rows_of_the_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix_documents(docs, seed=5)
    assert mixed.columns == docs.columns
    total, texts = {}, {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in mixed.collect():
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + words(r["text"])
    want = {r["doc_id"]: r["taken"] for r in mix_sources(docs, seed=5).collect() if r["taken"]}
    assert total == want


def test_one_source_and_caps_for_all(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "e f", "x")], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mix_sources(docs, share=1.5).orderBy("doc_id").collect()][0][0] == 9.0
    assert {r["taken"] for r in mix_sources(docs, share=5.0).collect()} == {8, 4}


def test_empty_table_and_rows_without_words(none, spark):
    assert mix_sources(none).count() == 0 and mix_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "s")], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mix_sources(blank).collect()] == [(0, 0.0, 0)] * 2


def test_first_words(spark):
    cases = [(" a  b\nc ", 2, " a  b"), ("a b", 0, ""), ("a\xa0b c", 1, "a\xa0b"), ("\x0ba\x1cb\x0c c", 1, "\x0ba\x1cb")]
    found = spark.createDataFrame(cases, "t string, n long, want string").select(first_words(F.col("t"), F.col("n")).alias("x"), "want")
    assert all(r["x"] == r["want"] for r in found.collect())


def test_mix_of_hard_rows_keeps_columns_of_any_name(docs):
    """Also such as the operator itself uses: each row of the mix is a document's, cut behind a word."""
    names = ["doc", "id", "cell", "order", "taken", "of", "left", "edge", "whole", "target", "source_size", "_size", "_source", "_cell", "_order", "_taken", "_copy"]
    wide = docs.withColumns({x: F.concat(F.lit(x), F.coalesce(F.col("n").cast("string"), F.lit(""))) for x in names})
    rows = {r["n"]: r for r in wide.collect()}
    mixed, total = mix_documents(wide, seed=3), {}
    assert mixed.columns == wide.columns
    for r in mixed.collect():
        of = rows[r["n"]]
        assert of["text"].startswith(r["text"]) and all(r[c] == of[c] for c in wide.columns if c not in ("text", "n_chars"))
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + words(r["text"])
    want = {}
    for r in mix_sources(docs, seed=3).where("taken > 0").collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert total == want
