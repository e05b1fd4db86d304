"""Grouping, grouping sets and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 6) AS avg_price,
       min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def agg_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 6).alias("avg_price"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.count("*").alias("n"),
    )


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT l_linenumber, count(*) FILTER (WHERE l_tax > 0.04) AS taxed, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_linenumber")
def agg_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_linenumber").agg(F.count_if(F.col("l_tax") > 0.04).alias("taxed"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def agg_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 12")


_GROUPED = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INTEGER) AS g FROM orders GROUP BY"


def _levels(df) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("g"))


@query(f"{_GROUPED} CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority"))


@query(f"{_GROUPED} ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority"))


@query(f"{_GROUPED} GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return _levels(table(spark, sf_dir, "orders").groupingSets([[status], [priority]], status, priority))


@query("""
SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var,
       round(corr(l_quantity, l_extendedprice), 6) AS corr, round(covar_samp(l_quantity, l_discount), 6) AS cov, round(kurtosis_pop(l_quantity), 6) AS kurt
FROM lineitem GROUP BY l_returnflag
""")
def agg_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_returnflag").agg(
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("var"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"), F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("cov"),
        F.round(F.kurtosis("l_quantity"), 6).alias("kurt"),
    )


@query("""
SELECT c_nationkey, first(c_custkey ORDER BY c_acctbal DESC, c_custkey) FILTER (WHERE c_acctbal IS NOT NULL) AS richest,
       first(c_custkey ORDER BY c_acctbal, c_custkey) FILTER (WHERE c_acctbal IS NOT NULL) AS poorest
FROM customer WHERE c_custkey IS NOT NULL GROUP BY c_nationkey
""")
def agg_max_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's customers of the highest and the lowest balance; of equal balances the smallest key. Customers without a balance don't count."""
    known = lambda *order: F.when(F.col("c_acctbal").isNotNull(), F.struct("c_acctbal", *order))
    return table(spark, sf_dir, "customer").where("c_custkey is not null").groupBy("c_nationkey").agg(
        F.max_by("c_custkey", known(F.bitwise_not("c_custkey"))).alias("richest"), F.min_by("c_custkey", known("c_custkey")).alias("poorest")
    )


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


_MODES = "SELECT p_brand, p_size AS size FROM (SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_size IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) = 1"


@query(_MODES)
def agg_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent size of each brand by the aggregate function, which keeps the few sizes there are; of sizes equally frequent the smallest."""
    return table(spark, sf_dir, "part").where("p_size is not null").groupBy("p_brand").agg(F.mode("p_size", True).alias("size"))


@query(_MODES)
def agg_mode_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for columns of many values: counted by value first."""
    sizes = table(spark, sf_dir, "part").where("p_size is not null").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return sizes.groupBy("p_brand").agg(F.max_by("p_size", F.struct("n", -F.col("p_size"))).alias("size"))


@query()
def agg_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of distinct counts and quantiles."""
    return _lines(spark, sf_dir).groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_orderkey", 0.02).alias("orders_sketch"),
        F.percentile_approx("l_quantity", 0.9, 1000).alias("q90_sketch"),
    )
