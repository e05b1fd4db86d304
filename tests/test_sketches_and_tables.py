"""Sketches' errors and roll-ups, table functions over nulls, folders that are not read."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millrace.functions import udtf
from millrace.operators import pruning
from millrace.operators.sketches import KLL_K, distinct, quantile, rolled_up, sketched


def test_roll_up_is_the_direct_sketch(spark):
    """Within the error of either."""
    n = 60_000
    rows = spark.range(n).selectExpr("id % 7 g", "id % 300 day", "(id * 7919) % 20011 item", "cast((id * 104729) % 60000 as double) value")
    direct = sketched(rows, ["g"], "item", "value").select("g", "n", distinct().alias("d"), quantile(0.5).alias("q"), quantile(0.99).alias("h"))
    rolled = rolled_up(sketched(rows, ["g", "day"], "item", "value"), ["g"]).select("g", "n", distinct().alias("d"), quantile(0.5).alias("q"), quantile(0.99).alias("h"))
    exact = {r["g"]: r for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("item").alias("d")).collect()}
    values = {g: sorted(r["value"] for r in rows.where(F.col("g") == g).collect()) for g in range(7)}
    bound = 3 * 2.3 / KLL_K**0.9021
    a, b = ({r["g"]: r for r in x.collect()} for x in (direct, rolled))
    for g, r in exact.items():
        assert a[g]["n"] == b[g]["n"] == r["n"] and abs(a[g]["d"] - b[g]["d"]) <= 0.025 * r["d"]
        assert abs(b[g]["d"] - r["d"]) <= 0.03 * r["d"]
        for x in (a[g], b[g]):
            for share, name in ((0.5, "q"), (0.99, "h")):
                rank = sum(v <= x[name] for v in values[g]) / len(values[g])
                assert abs(rank - share) <= bound


def test_groups_of_nulls(spark):
    rows = spark.createDataFrame([("a", 1, None, None), ("a", 2, None, None), ("b", 1, 5, 2.5), (None, 1, 6, 1.0)], "g string, day int, item long, value double")
    found = {r["g"]: tuple(r)[1:] for r in rolled_up(sketched(rows, ["g", "day"], "item", "value"), ["g"]).select("g", "n", distinct(), quantile(0.5)).collect()}
    assert found == {"a": (2, 0, None), "b": (1, 1, 2.5), None: (1, 1, 1.0)}
    assert rolled_up(sketched(rows.limit(0), ["g", "day"], "item", "value"), ["g"]).count() == 0


def test_shingles_of_odd_texts(spark):
    udtf.registered(spark)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, " a  b c ")], "id long, t string")
    found = spark.sql("SELECT id, s.* FROM {rows}, LATERAL shingles(t, 2) s", rows=rows).collect()
    assert [tuple(r) for r in found] == [(4, 1, "a", "b"), (4, 2, "b", "c")]
    assert spark.sql("SELECT * FROM {rows}, LATERAL shingles(t, 3)", rows=rows).columns == ["id", "t", "place", "word1", "word2", "word3"]
    with pytest.raises(AnalysisException, match="constant"):
        spark.sql("SELECT * FROM {rows}, LATERAL shingles(t, 0)", rows=rows)


def test_runs_over_nulls(spark):
    udtf.registered(spark)
    rows = [(1, 1, 10, "a"), (2, 1, 11, "a"), (3, 1, 12, None), (4, 1, 13, None), (5, 1, 14, "a"), (6, None, 1, "b"), (7, None, 2, "b"), (8, 2, None, "c")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string")
    found = spark.sql("SELECT * FROM runs(TABLE({events}))", events=events).collect()
    assert {tuple(r) for r in found} == {(1, "a", 1, 2), (1, None, 3, 2), (1, "a", 5, 1), (None, "b", 6, 2), (2, "c", 8, 1)}
    with pytest.raises(AnalysisException, match="event_type"):
        spark.sql("SELECT * FROM runs(TABLE({events}))", events=events.drop("event_type"))


def test_folders_that_are_not_needed_are_not_read(spark):
    """The scan has a filter that the other side gives as it runs, and reads fewer files."""
    facts = pruning.by_folder(spark.range(1000).selectExpr("id", "id % 20 day"), "day")
    needed = spark.range(20).selectExpr("id day", "id * 3 x").where("x = 9")
    found = pruning.folders_needed(facts, needed, "day")
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in found.collect()) == list(range(3, 1000, 20))
    assert len(found.inputFiles()) >= 20 and found.select(F.input_file_name()).distinct().count() < 20
