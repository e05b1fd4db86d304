import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_near_dedup import brute

import __spark_entry__


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives, over the documents of the middle size."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"input": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        out[name] = docs.toPandas()
    return out


def test_columns(stages):
    for name in ("quality", "exact_dedup", "near_dedup", "mixing"):
        assert list(stages[name].columns) == list(stages["input"].columns)


def test_quality_keeps_clean_documents(stages, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id")
    kept = labels.index.isin(stages["quality"]["doc_id"])
    assert kept[labels["quality"] == 1].mean() > 0.99 and kept[labels["quality"] == 0].mean() < 0.2


def test_copies_go(stages):
    before, after = stages["quality"], stages["exact_dedup"]
    norm = lambda t: "".join(t.split())
    assert set(before["text"].map(norm)) == set(after["text"].map(norm)) and not after["text"].map(norm).duplicated().any()


def test_near_copies_go_as_brute_force_says(stages):
    before = stages["exact_dedup"]
    want = {i for i, r in brute(list(before[["doc_id", "text"]].itertuples(index=False, name=None)), 5).items() if r[2]}
    assert set(stages["near_dedup"]["doc_id"]) == want


def test_mix_and_sequences(stages):
    docs, mixed, packed = stages["near_dedup"], stages["mixing"], stages["packing"]
    words = lambda f: int(f["text"].str.split().str.len().sum())
    assert abs(words(mixed) / words(docs) - 1.5) < 0.01
    assert set(packed["doc_id"]) == set(mixed["doc_id"]) and (packed.groupby("sequence_id")["length"].sum() <= 2048).all()
    assert (packed["piece"] == 0).sum() == len(mixed)


def test_registered(spark):
    known = __spark_entry__.queries()
    assert "pipeline" in known and {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in known if q.startswith("op")}


@pytest.mark.parametrize("table", ["docs", "none"])
def test_hard_rows_and_an_empty_table(spark, table, request, tmp_path):
    """Nulls, blanks, copies, very long texts, clashing columns: all stages run, and what is packed are pieces of documents that stay."""
    docs = request.getfixturevalue(table)
    wide = docs.withColumns({x: F.lit(x) for x in ("_gone", "_id", "_size", "_source", "_cell", "doc", "taken", "bucket")})
    out = {"input": wide}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = corpus_pipeline.written(stage(spark, out[list(out)[-1]], str(tmp_path)), name)
    for name in ("quality", "exact_dedup", "near_dedup", "mixing"):
        assert out[name].columns == wide.columns
    ids = {name: {r["doc_id"] for r in t.select("doc_id").collect()} for name, t in out.items()}
    assert ids["packing"] == ids["mixing"] <= ids["near_dedup"] <= ids["exact_dedup"] <= ids["quality"] <= ids["input"]
    assert bool(ids["packing"]) == (table == "docs")
    assert all(r["length"] <= 2048 for r in out["packing"].collect())


def test_run_is_the_stages_one_after_another(spark, stages):
    want = stages["packing"][["doc_id", "piece", "length", "ids_crc32"]].sort_values(["doc_id", "piece", "ids_crc32"]).to_numpy().tolist()
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.01").toPandas()
    assert found[["doc_id", "piece", "length", "ids_crc32"]].sort_values(["doc_id", "piece", "ids_crc32"]).to_numpy().tolist() == want


def test_queries_of_the_library_stay_without_the_subpackage(monkeypatch, tmp_path):
    monkeypatch.setattr(__spark_entry__, "__file__", str(tmp_path / "__spark_entry__.py"))
    known = __spark_entry__.queries()
    assert "report_pricing" in known and not any(q.startswith("op") or q == "pipeline" for q in known)
    assert set(__spark_entry__.oracle_sql()) <= set(known)
