"""Sketches that are stored as binaries and merged: distinct counts (HLL) and quantiles (KLL).

A sketch of each small group is a column of a table; sketches of larger groups come from merging these, without the rows. What is merged is
what a direct sketch would be, within the same error: with LG_K bits a distinct count is off by about 1.04 / sqrt(2 ** LG_K) of itself,
a quantile's rank by about 2.3 / KLL_K ** 0.9021. Null values are in no sketch; a group of null values only has a count of 0 and no quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import scratch, table

#: Bits of a distinct count's registers, and the size of a quantile sketch.
LG_K, KLL_K = 14, 400


def sketched(rows: DataFrame, by: Sequence[str], item: str, value: str) -> DataFrame:
    """by, n, items (a sketch of distinct items), amounts (a sketch of values)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(item, F.lit(LG_K)).alias("items"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("amounts"))


def rolled_up(sketches: DataFrame, by: Sequence[str], step: int = 64) -> DataFrame:
    """The same columns for larger groups, from the sketches of smaller ones. Quantile sketches are merged `step` at a time, so no group gathers more in a row."""
    part = F.pmod(F.xxhash64(*(F.col(c) for c in sketches.columns)), F.lit(step)).alias("_part")
    merge = lambda a: F.aggregate(F.slice(a, 2, F.size(a) - 1), a[0], F.kll_sketch_merge_double)
    level = lambda rows, keys: rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), merge(F.collect_list("amounts")).alias("amounts"))
    keys = [F.col(c) for c in by]
    return level(level(sketches.select("*", part), [*keys, F.col("_part")]), keys)


def distinct(sketch: str = "items") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(share: float, sketch: str = "amounts") -> Column:
    """The value at a share of the rows; null if there are no values."""
    some = F.kll_sketch_get_n_double(sketch) > 0
    return F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col(sketch)), F.lit(share)))


@query()
def agg_sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and values of each event type, from a stored table of daily sketches."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    path = scratch(spark)
    sketched(events, ["event_type", "day"], "user_id", "value").write.parquet(path)
    rolled = rolled_up(spark.read.parquet(path), ["event_type"])
    return rolled.select("event_type", "n", distinct().alias("users"), quantile(0.5).alias("middle"), quantile(0.9).alias("high"))
