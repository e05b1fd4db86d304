"""Filters, joins, set operations, subqueries, top-k and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import table


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 24")
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_discount >= 0.05 and l_quantity < 24")
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size IN (1, 5, 9) AND p_retailprice BETWEEN 900 AND 1500 AND p_name LIKE '%e%'")
def filter_in_between_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.where(F.col("p_size").isin(1, 5, 9) & F.col("p_retailprice").between(900, 1500) & F.col("p_name").like("%e%")).select("p_partkey", "p_name", "p_size")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') RIGHT JOIN lineitem ON o_orderkey = l_orderkey")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return orders.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "right").select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "full").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, p_partkey, p_size FROM customer FULL JOIN part ON c_nationkey = p_size AND c_custkey = p_partkey")
def join_full_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables, with customers and parts that match and others on both sides that don't."""
    on = (F.col("c_nationkey") == F.col("p_size")) & (F.col("c_custkey") == F.col("p_partkey"))
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "part"), on, "full").select("c_custkey", "p_partkey", "p_size")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return table(spark, sf_dir, "orders").join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_totalprice")


@query("""
SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's last view at or before each purchase: one sort by user and time, no join."""
    events = table(spark, sf_dir, "events").where("event_type in ('view', 'purchase')")
    upto = Window.partitionBy("user_id").orderBy("ts", F.desc("event_type")).rowsBetween(Window.unboundedPreceding, 0)
    # only views of a user and a time are seen; a struct, so that a view without an id isn't passed over
    view = F.when((F.col("event_type") == "view") & F.col("user_id").isNotNull() & F.col("ts").isNotNull(), F.struct("event_id"))
    seen = events.withColumn("seen", F.last(view, ignorenulls=True).over(upto))
    return seen.where("event_type = 'purchase'").select("event_id", F.col("seen.event_id").alias("view_id"))


_LOW = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 2000"
_HIGH = "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 2000"


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    low = table(spark, sf_dir, "customer").where("c_acctbal < 2000").select(F.col("c_nationkey").alias("k"))
    return low, table(spark, sf_dir, "supplier").where("s_acctbal > 2000").select(F.col("s_nationkey").alias("k"))


@query(f"{_LOW} UNION ALL {_HIGH}")
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return a.unionByName(b)


@query(f"{_LOW} UNION {_HIGH}")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return a.unionByName(b).distinct()


@query(f"{_LOW} INTERSECT {_HIGH}")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return a.intersect(b)


@query(f"{_LOW} INTERSECT ALL {_HIGH}")
def set_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return a.intersectAll(b)


@query(f"{_LOW} EXCEPT {_HIGH}")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return a.subtract(b)


@query(f"{_LOW} EXCEPT ALL {_HIGH}")
def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return a.exceptAll(b)


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def subquery_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    mean = orders.groupBy("o_custkey").agg((1.5 * F.avg("o_totalprice")).alias("bound"))
    return orders.join(mean, "o_custkey").where("o_totalprice > bound").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def top_k_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("rank", rank).where("rank <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery
FROM customer GROUP BY c_nationkey
""")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    return counts.select("c_nationkey", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))


@query("""
SELECT s_suppkey, 'balance' AS measure, s_acctbal AS value FROM supplier
UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier
""")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return wide.unpivot("s_suppkey", ["balance", "nation"], "measure", "value")


_TREE = """
SELECT 'r' || r_regionkey AS node, r_name AS root, 0 AS depth FROM {region}
UNION ALL SELECT child, root, depth + 1 FROM tree JOIN edge ON parent = node"""
_EDGE = """
SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM {nation}
UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM {supplier}
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM {customer}
UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM {orders}"""
_NAMES = ("region", "nation", "supplier", "customer", "orders")
_COUNTED = "SELECT root, depth, count(*) AS n FROM tree GROUP BY root, depth"


@query(f"WITH RECURSIVE edge AS ({_EDGE}), tree AS ({_TREE}) {_COUNTED}".format(**{x: x for x in _NAMES}))
def recursive_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes at each depth below a region: nations, suppliers and customers, orders. LIMIT ALL lifts the session's limit of a million rows of a recursion."""
    tables = {x: table(spark, sf_dir, x) for x in _NAMES}
    whole = _COUNTED.replace("FROM tree", "FROM (SELECT * FROM tree LIMIT ALL)")
    return spark.sql(f"WITH RECURSIVE edge AS ({_EDGE}), tree (node, root, depth) AS ({_TREE}) {whole}", **tables)
