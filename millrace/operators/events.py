"""Event analytics: time windows, sessions, funnels, retention. Events without a time are in no window, those without a user in no funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import table


def _text(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(_text("w.start").alias("start"), "event_type", "n", "total")


@query("""
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n
FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events WHERE ts IS NOT NULL) GROUP BY ALL
""")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(_text("w.start").alias("start"), "n")


@query("""
WITH a AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM b GROUP BY user_id, s
""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", _text("w.start").alias("start"), "n")


@query("""
WITH v AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id),
c AS (SELECT e.user_id, min(ts) AS t FROM events e JOIN v USING (user_id) WHERE event_type = 'click' AND ts > v.t GROUP BY e.user_id),
p AS (SELECT e.user_id, min(ts) AS t FROM events e JOIN c USING (user_id) WHERE event_type = 'purchase' AND ts > c.t GROUP BY e.user_id)
SELECT (SELECT count(*) FROM v) AS viewed, (SELECT count(*) FROM c) AS clicked, (SELECT count(*) FROM p) AS purchased
""")
def events_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First view, then a click, then a purchase: each step is a running minimum in one order by user and time."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    events = table(spark, sf_dir, "events").where("user_id is not null and ts is not null").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    is_type = lambda x: F.col("event_type") == x
    a = events.withColumn("viewed", F.max(is_type("view")).over(w))
    a = a.withColumn("click", is_type("click") & F.coalesce("viewed", F.lit(False)))
    a = a.withColumn("buy", is_type("purchase") & F.coalesce(F.max("click").over(w), F.lit(False)))
    users = a.groupBy("user_id").agg(F.max(is_type("view")).alias("v"), F.max("click").alias("c"), F.max("buy").alias("p"))
    return users.agg(F.count_if("v").alias("viewed"), F.count_if("c").alias("clicked"), F.count_if("p").alias("purchased"))


@query("""
WITH f AS (SELECT user_id, min(CAST(ts AS DATE)) AS d FROM events WHERE ts IS NOT NULL GROUP BY user_id)
SELECT CAST(date_diff('day', d, CAST(ts AS DATE)) AS INTEGER) AS day, count(DISTINCT user_id) AS users FROM events JOIN f USING (user_id) WHERE ts IS NOT NULL GROUP BY ALL
""")
def events_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").where("user_id is not null and ts is not null").select("user_id", F.to_date("ts").alias("d")).distinct()
    first = F.min("d").over(Window.partitionBy("user_id"))
    return days.withColumn("day", F.date_diff("d", first)).groupBy("day").agg(F.count("*").alias("users"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(sum(value)) OVER (ORDER BY CAST(ts AS DATE)), 4) AS total FROM events GROUP BY 1")
def events_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are summed first; the running total orders one row for each day."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return days.select("day", "n", F.round(F.sum("v").over(Window.orderBy(F.asc_nulls_last("day"))), 4).alias("total"))
