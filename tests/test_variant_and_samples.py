"""VARIANT over bad and odd JSON; samples that stay the same and have the numbers asked for."""

from compare import rows

from millrace.functions.variant import parsed, read
from millrace.operators.sampling import sample_keys, sample_strata, sample_weighted


def test_odd_json(spark):
    texts = [None, "", "{", "nul", "null", "[]", '{"k": "12"}', '{"k": 12.75}', '{"k": {"k": 1}}', '{"k": null}', '{"k": 99999999999}', '[{"k": 1}]', '"k"', '{"k": true}']
    frame = parsed(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t")
    found = {r["id"]: r for r in frame.select("id", "v", *read("v", {"n": ("$.k", "int"), "s": ("$.k", "string"), "first": ("$[0].k", "int")})).collect()}
    assert [k for k, r in found.items() if r["v"] is None] == [0, 1, 2, 3]
    assert {k: r["n"] for k, r in found.items() if r["n"] is not None} == {6: 12, 7: 12, 13: 1}
    assert found[10]["s"] == "99999999999" and found[8]["s"] == '{"k":1}' and found[9]["s"] is None and found[11]["first"] == 1


def test_keys_are_drawn_alike_however_rows_are_dealt(spark):
    made = spark.range(5000).selectExpr("id", "id % 400 k").unionByName(spark.sql("select 1L id, cast(null as bigint) k"))
    a = sample_keys(made, "k", 0.3, seed=2)
    assert rows(a.toPandas()) == rows(sample_keys(made.repartition(7, "id"), "k", 0.3, seed=2).toPandas())
    keys = {r["k"] for r in a.collect()}
    assert 80 < len(keys) < 160 and a.count() == made.where(made["k"].isin([k for k in keys if k is not None])).count() + (None in keys)
    assert keys <= {r["k"] for r in sample_keys(made, "k", 0.6, seed=2).collect()} and keys != {r["k"] for r in sample_keys(made, "k", 0.3, seed=3).collect()}
    assert sample_keys(made, "k", 1.0).count() == made.count() and sample_keys(made, "k", 0.0).count() == 0


def test_strata_have_their_numbers(spark):
    made = spark.range(3000).selectExpr("id", "case when id < 2500 then 'hot' when id < 2507 then 'few' when id < 2990 then 'mid' end s")
    found = sample_strata(made, "s", "id", 20, seed=1)
    assert {r["s"]: r["count"] for r in found.groupBy("s").count().collect()} == {"hot": 20, "few": 7, "mid": 20, None: 10}
    assert rows(found.toPandas()) == rows(sample_strata(made.repartition(9), "s", "id", 20, seed=1).toPandas())
    assert found.columns == ["id", "s"]


def test_weights_count(spark):
    made = spark.range(2000).selectExpr("id", "case when id < 100 then 100.0D when id < 1900 then 1.0D when id = 1950 then null else 0.0D end w")
    found = [r["id"] for r in sample_weighted(made, "id", "w", 60, seed=4).collect()]
    assert len(set(found)) == 60 and sum(i < 100 for i in found) > 40 and max(found) < 1900
    assert found == [r["id"] for r in sample_weighted(made.repartition(5), "id", "w", 60, seed=4).collect()]
    assert sample_weighted(made, "id", "w", 5000).count() == 1900
