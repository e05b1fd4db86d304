"""Seeded samples: by key, by stratum with exact numbers, and with weights. A row's draw comes from a hash of seed and key, so reruns, other
partitionings and other clusters give the same rows, and a larger share has all rows of a smaller one.

Rows that share a key are in or out together in a sample by key; in a stratified one they are told apart by the columns given as `ties`. A null key is a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import table

#: Hexadecimal digits of a draw: 2 ** 60 values.
DIGITS = 15


def draw(key: str, seed: int) -> Column:
    """A whole number from 0, below 2 ** 60, that seed and key decide."""
    known = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(known), 1, DIGITS), 16, 10).cast("long")


def sample_keys(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """The rows whose key is drawn, each with probability share. No shuffle."""
    return rows.where(draw(key, seed) < F.lit(int(share * 16**DIGITS)))


def sample_strata(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each stratum, all of a smaller one: those of the smallest draws, ties by key. Tasks send n rows of a stratum at most."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("_draw", key))
    return rows.withColumn("_draw", draw(key, seed)).withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_draw", "_rank")


def sample_weighted(rows: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, drawn in proportion to their weights: those of the largest u ** (1 / w). Rows of no, negative or null weight are left out."""
    u = (draw(key, seed) + 1) / F.lit(float(16**DIGITS))
    score = F.ln(u) / F.col(weight)
    return rows.where(F.col(weight) > 0).withColumn("_score", score).orderBy(F.desc("_score"), key).limit(n).drop("_score")


_DRAW = "md5('{seed}:' || coalesce(CAST({key} AS VARCHAR), ''))"


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE substr({_DRAW.format(seed=5, key='o_custkey')}, 1, 15) < '199999999999999'")
def sample_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of a tenth of the customers."""
    return sample_keys(table(spark, sf_dir, "orders"), "o_custkey", 0x199999999999999 / 16**15, seed=5).select("o_orderkey", "o_custkey")


@query(f"SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY substr({_DRAW.format(seed=9, key='p_partkey')}, 1, 15), p_partkey) <= 5")
def sample_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five parts of each brand."""
    return sample_strata(table(spark, sf_dir, "part"), "p_brand", "p_partkey", 5, seed=9).select("p_partkey", "p_brand")


@query()
def sample_orders_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred orders, in proportion to their price."""
    return sample_weighted(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", 100, seed=3).select("o_orderkey", "o_totalprice")
