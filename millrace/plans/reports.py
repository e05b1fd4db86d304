"""Reports over several tables. Joins are left to the optimiser: no side is forced to be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import table


def revenue() -> F.Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) AS charge, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY l_returnflag, l_linestatus
""")
def report_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(revenue()), 4).alias("revenue"),
        F.round(F.sum(revenue() * (1 + F.col("l_tax"))), 4).alias("charge"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"),
    )


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name
""")
def report_revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= day("1996-01-01")) & (F.col("o_orderdate") < day("1997-01-01")))
    joined = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum(revenue()), 4).alias("revenue"))


@query("""
SELECT r_name, p_type, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE p_size > 25 GROUP BY r_name, p_type
""")
def report_supply_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").where("p_size > 25"), F.col("l_partkey") == F.col("p_partkey"))
    joined = joined.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = joined.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "p_type").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent, strftime(max(o_orderdate), '%Y-%m-%d') AS last
FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 100
""")
def report_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("s"), F.max("o_orderdate").alias("d"))
    return spent.orderBy(F.desc("s"), "o_custkey").limit(100).select("o_custkey", "orders", F.round("s", 2).alias("spent"), F.date_format("d", "yyyy-MM-dd").alias("last"))


@query("""
SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority
""")
def report_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""
SELECT p_brand, p_partkey, round(q, 2) AS quantity, round(q / sum(q) OVER (PARTITION BY p_brand), 8) AS share
FROM (SELECT p_brand, p_partkey, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
""")
def report_share_of_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))  # before the join: a row for each part
    parts = sold.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    totals = parts.groupBy("p_brand").agg(F.sum("q").alias("total"))  # few brands, so no task gets all parts of one
    totals = totals.withColumnRenamed("p_brand", "of")
    return parts.join(totals, F.col("p_brand").eqNullSafe(F.col("of"))).select("p_brand", "p_partkey", F.round("q", 2).alias("quantity"), F.round(F.col("q") / F.col("total"), 8).alias("share"))
