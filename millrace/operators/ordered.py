"""Running sums, quantiles and counts in ranges over a total order, without one task that sorts all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import scratch, table


def running_sum(rows: DataFrame, by: Sequence[str], order: Sequence[str], amount: str) -> DataFrame:
    """rows with `running`: the sum of amount over the rows of the same `by` up to and with their own, in order.

    Rows are dealt into ranges, each range is summed by itself, and the sums of the ranges before are
    added. Rows that are equal in all of order lie in one range, so they should be summed up beforehand.
    """
    path = scratch(rows.sparkSession)
    ranged = rows.repartitionByRange(*by, *order).withColumn("range", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = rows.sparkSession.read.schema(ranged.schema).parquet(path)
    sums = ranged.groupBy(*by, "range").agg(F.sum(amount).alias("own"))  # a row for each range, or for each of by
    before = F.coalesce(F.sum("own").over(Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*(F.col(c).alias(f"{c}_of") for c in by), F.col("range").alias("range_of"), before.alias("before"))
    same = F.col("range") == F.col("range_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    inside = Window.partitionBy("range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("inside", F.sum(amount).over(inside))
    return summed.join(starts, same).select(*rows.columns, (F.col("before") + F.col("inside")).alias("running"))


def quantiles(rows: DataFrame, by: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """by and a column for each name: the exact quantile (column, share) of each group, between two values in proportion. Nulls don't count; one order serves all."""
    pairs = F.array(*(F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value"), F.lit(float(share)).alias("share")) for name, (c, share) in wanted.items()))
    counts = rows.select(by, F.explode(pairs).alias("x")).where("x.value is not null").groupBy(by, "x.name", "x.value", "x.share").agg(F.count("*").alias("n"))
    path = scratch(rows.sparkSession)  # read three times: to find ranges, to sort, and for the totals
    counts.write.parquet(path)
    counts = rows.sparkSession.read.schema(counts.schema).parquet(path)
    placed = running_sum(counts, [by, "name"], ["value"], "n")
    totals = counts.groupBy(F.col(by).alias("_by"), F.col("name").alias("_name")).agg(((F.sum("n") - 1) * F.max("share")).alias("place"))
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("name") == F.col("_name"))
    near = placed.join(totals, same)
    at = lambda rank: F.max(F.when((F.col("running") > rank) & (F.col("running") - F.col("n") <= rank), F.col("value")))
    found = near.groupBy(by, "name").agg(at(F.floor("place")).alias("low"), at(F.ceil("place")).alias("high"), F.first("place").alias("place"))
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))
    each = found.groupBy(F.col(by).alias("_by")).agg(*(F.max(F.when(F.col("name") == name, value)).alias(name) for name in wanted))
    # groups without a value are there, too
    return rows.select(by).distinct().join(each, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


@query("SELECT l_returnflag, median(l_quantity) AS mid, round(quantile_cont(l_extendedprice, 0.25), 4) AS low FROM lineitem GROUP BY l_returnflag")
def agg_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    found = quantiles(lines, "l_returnflag", {"mid": ("l_quantity", 0.5), "low": ("l_extendedprice", 0.25)})
    return found.select("l_returnflag", "mid", F.round("low", 4).alias("low"))


@query("SELECT s_suppkey, count(*) AS n FROM supplier JOIN part ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 50 GROUP BY s_suppkey")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a range join, counted without making them: what lies up to a range's end, less what lies before its start."""
    prices = table(spark, sf_dir, "part").where("p_retailprice is not null").groupBy(F.col("p_retailprice").alias("at")).agg(F.count("*").alias("n"))
    bounds = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(F.struct(F.col("s_acctbal").alias("at"), F.lit(0).alias("place")), F.struct((F.col("s_acctbal") + 50).alias("at"), F.lit(2).alias("place")))).alias("b"))
    points = prices.select(F.lit(None).cast("long").alias("s_suppkey"), "at", F.lit(1).alias("place"), "n").unionByName(bounds.select("s_suppkey", "b.at", "b.place", F.lit(0).cast("long").alias("n")))
    counted = running_sum(points.where("at is not null"), [], ["at", "place"], "n").where("place <> 1")
    return counted.groupBy("s_suppkey").agg(F.sum(F.when(F.col("place") == 2, F.col("running")).otherwise(-F.col("running"))).alias("n")).where("n > 0")
