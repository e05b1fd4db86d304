"""Queries that read whole tables: a mode that is computed, a full join with unmatched rows on both sides."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from millrace.operators.ordered import quantiles, running_sum
from millrace.registry import QUERIES, SQL


def test_mode_of_all_sizes(spark, sf_dir):
    sizes = defaultdict(Counter)
    for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_size").collect():
        sizes[r["p_brand"]][r["p_size"]] += 1
    want = {b: min(c, key=lambda s: (-c[s], s)) for b, c in sizes.items()}
    assert {r["p_brand"]: r["size"] for r in QUERIES["agg_mode_sizes"](spark, sf_dir).collect()} == want and len(set(want.values())) > 1


def test_full_join_has_all_rows_of_both(spark, sf_dir):
    found = QUERIES["join_full_tables"](spark, sf_dir).toPandas()
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        assert sorted(found[key].dropna()) == sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key).collect())
    assert found["c_custkey"].isna().any() and found["p_partkey"].isna().any() and found.notna().all(axis=1).any()


def test_mode_by_the_aggregate_function_is_the_same(spark, sf_dir):
    pairs = lambda name: {(r["p_brand"], r["size"]) for r in QUERIES[name](spark, sf_dir).collect()}
    assert pairs("agg_mode") == pairs("agg_mode_sizes")


def test_running_sums_over_ranges(spark):
    """Groups of any size, ties summed up beforehand, nulls in the group."""
    rows = [(None if k % 11 == 0 else k % 3, (k * 37) % 501, k % 5) for k in range(501)]
    found = running_sum(spark.createDataFrame(rows, "g int, x int, n long").repartition(7), ["g"], ["x"], "n").collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["running"] == sum(n for g, x, n in rows if g == r["g"] and x <= r["x"])


def test_quantiles_of_small_groups(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", 5.0), ("c", None), ("b", 5.0)]
    found = quantiles(spark.createDataFrame(rows, "g string, x double"), "g", {"q": ("x", 0.25)}).collect()
    assert {r["g"]: r["q"] for r in found} == {"a": 1.5, "b": 5.0, "c": None}  # as SQL gives a group without values


def test_shares_are_no_window_over_brands(spark, sf_dir):
    assert "Window" not in QUERIES["report_share_of_brand"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_state_of_quiet_users_is_given_up(spark, sf_dir):
    """Totals are whole though each user's state goes after a day."""
    want = {r["user_id"]: r["n"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count().withColumnRenamed("count", "n").collect()}
    assert {r["user_id"]: r["n"] for r in QUERIES["stream_custom_state"](spark, sf_dir).collect()} == want


def test_recursion_has_no_limit_of_rows(spark, sf_dir):
    """The session's limit, a million rows, is below what larger tables give."""
    whole = sorted(map(tuple, QUERIES["recursive_cte"](spark, sf_dir).collect()))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        assert sorted(map(tuple, QUERIES["recursive_cte"](spark, sf_dir).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert sum(r[2] for r in whole) > 1000


def test_equal_balances_go_to_the_smallest_key(spark, tmp_path):
    """In any order of rows; customers without a balance don't count."""
    import duckdb

    made = [(k, k % 2, None if k % 5 == 0 else float(k % 3)) for k in range(40)] + [(50, 7, None), (None, 0, 99.0)]
    want = {(0, 2, 6), (1, 11, 3), (7, None, None)}
    for order in ("c_custkey", "-c_custkey"):
        rows = spark.createDataFrame(made, "c_custkey long, c_nationkey int, c_acctbal double").coalesce(1).orderBy(F.expr(order))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/customer.parquet")
        assert {tuple(r) for r in QUERIES["agg_max_by"](spark, str(tmp_path)).collect()} == want
        con = duckdb.connect()
        con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
        assert set(con.sql(SQL["agg_max_by"]).fetchall()) == want
