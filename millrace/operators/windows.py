"""Window functions. Nulls come last in their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import table

_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def _by_user() -> Window:
    return Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))


@query(f"""
SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS rk, CAST(dense_rank() OVER w AS INTEGER) AS dr,
       CAST(ntile(4) OVER w AS INTEGER) AS tile, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd
FROM events {_W}
""")
def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _by_user()
    return table(spark, sf_dir, "events").select(
        "event_id", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"),
        F.ntile(4).over(w).alias("tile"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"),
    )


@query(f"""
SELECT event_id, lag(event_type) OVER w AS before, lead(event_type, 2) OVER w AS after, first_value(event_id) OVER w AS first_id, nth_value(event_id, 2) OVER w AS second_id
FROM events {_W}
""")
def window_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _by_user()
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type", 2).over(w).alias("after"), F.first("event_id").over(w).alias("first_id"), F.nth_value("event_id", 2).over(w).alias("second_id"))


@query(f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving, round(sum(value) OVER w, 4) AS running FROM events {_W}")
def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _by_user()
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w.rowsBetween(-3, 0)), 6).alias("moving"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day FROM events")
def window_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-86_400_000_000, 0)
    return events.select("event_id", F.count("*").over(w).alias("last_day"))
