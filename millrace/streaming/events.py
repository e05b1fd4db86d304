"""Streams over the events table. Each reads it file by file as a stream of files gives it, runs until all are read, and returns its result.

Nothing is sorted or copied beforehand. How far a file's events lie behind those of files before it, the table's disorder,
is measured by one aggregate of times by file, and the watermark waits for so long: no event of the table is late, and state goes
as soon as the order of files allows. `millrace.streaming.late` is about events that come later than the watermark waits.

What a watermark would only close after the end of the table is read from the stream's state: closed windows come from
the sink, open ones from the state store. Windows and sessions hold the events that have a time. Checkpoints lie in the shared folder while a stream runs, and are deleted with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.registry import query
from millrace.sources.tables import discard, scratch, table

#: Least time that a watermark waits.
DELAY = 60 * 60

#: Files of a micro-batch.
FILES = 4


def stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a stream, with an event time that watermarks accept. A table is a file or a folder of files."""
    schema = table(spark, sf_dir, name).schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", FILES)
    path = f"{sf_dir}/{name}.parquet"
    whole = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = whole.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(whole).isFile()
    rows = files.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if is_file else files.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def disorder(events: DataFrame) -> int:
    """Seconds by which the first event of a file lies behind the last one of files that may be read before it, at most. Files are read in order of their times; of equal ones any may come first."""
    files = events.groupBy("_metadata.file_path", "_metadata.file_modification_time").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    # a row for each time that files have: of its files, and of all earlier ones
    times = files.groupBy("file_modification_time").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first is not null")
    before = F.expr("max(last) over (order by file_modification_time rows between unbounded preceding and current row)")
    behind = times.withColumn("before", before).agg(F.max(F.unix_micros(F.col("before").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))))
    return max(0, (behind.first()[0] or 0) // 1_000_000) + 1


def timely(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a stream whose watermark waits long enough for each of its events."""
    delay = max(DELAY, disorder(table(spark, sf_dir, name)))
    return stream(spark, sf_dir, name).withWatermark("ts", f"{delay} seconds")


def run(df: DataFrame, mode: str = "append", rest: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that there is. In update mode the rows have the number of their `batch`. rest: from the checkpoint's path, what is still open in the state."""
    spark = df.sparkSession
    top = scratch(spark)
    out = df.writeStream.option("checkpointLocation", f"{top}/state").trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", f"{top}/sink").outputMode("append")
    else:
        # a batch that is run again writes its own folder again
        out = out.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{top}/sink/batch={n}"))
    out.start().awaitTermination()
    schema = df.schema if mode == "append" else StructType([*df.schema.fields]).add("batch", "long")
    found = spark.read.schema(schema).parquet(f"{top}/sink")
    if rest:
        rest(f"{top}/state").select(*df.columns).write.parquet(f"{top}/rest")
        found = found.unionByName(spark.read.schema(df.schema).parquet(f"{top}/rest"))
    discard(spark, f"{top}/state")
    return found


def _start(window: str = "w") -> F.Column:
    return F.date_format(F.col(window)["start"], "yyyy-MM-dd HH:mm:ss").alias("start")


def latest(found: DataFrame, *keys: str) -> DataFrame:
    """Of an update stream's rows, the last one for each key."""
    values = [c for c in found.columns if c not in (*keys, "batch")]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_tumbling_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch gives all windows; the last one's are the result."""
    found = run(stream(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(_start(), "n"), "complete")
    return latest(found, "start")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as batches change them; the watermark lets state go."""
    counts = timely(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return latest(run(counts.select(_start(), "event_type", "n"), "update"), "start", "event_type")


@query("""
WITH a AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM b GROUP BY user_id, s
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed, and those still open in the state."""
    def rest(state: str) -> DataFrame:
        held = spark.read.format("statestore").load(state)
        return held.select("key.user_id", _start("value.session_window"), F.col("value.count").alias("n"))

    sessions = timely(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return run(sessions.select("user_id", _start(), "n"), rest=rest)


@query("SELECT event_id, user_id FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event that has an id and a time once, though the stream is given twice."""
    events = timely(spark, sf_dir).where("event_id is not null and ts is not null")
    return run(events.unionByName(events).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"))


@query("""
SELECT p.event_id, v.event_id AS view_id FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts
WHERE p.event_type = 'purchase' AND v.event_type = 'view'
""")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the user's views of the hour before; the bound on time lets state go."""
    events = timely(spark, sf_dir)
    buy = events.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("u"), F.col("ts").alias("bought"))
    view = events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    return run(buy.join(view, F.expr("u = user_id and ts between bought - interval 1 hour and bought")).select("event_id", "view_id"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_custom_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by user in state of our own, given and forgotten once the user has been quiet for a day of event time. Events without a time count, too."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    day = 24 * 60 * 60 * 1000

    def add(key, frames, state):
        if state.hasTimedOut:
            n, valued, total, _ = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "n": [n], "valued": [valued], "total": [total]})
            return
        n, valued, total, last = state.get if state.exists else (0, 0, 0.0, 0)
        for f in frames:
            n, valued, total = n + len(f), valued + int(f["value"].count()), total + float(f["value"].sum())
            last = max([last, *(int(t.timestamp() * 1000) for t in f["ts"].dropna().nlargest(1))])
        state.update((n, valued, total, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + day)

    def rest(state: str) -> DataFrame:
        return spark.read.format("statestore").load(state).select("key.user_id", "value.groupState.n", "value.groupState.valued", "value.groupState.total")

    schema = "user_id long, n long, valued long, total double"
    events = timely(spark, sf_dir).select("user_id", "value", "ts")
    totals = events.groupBy("user_id").applyInPandasWithState(add, schema, "n long, valued long, total double, last long", "append", GroupStateTimeout.EventTimeTimeout)
    found = run(totals, rest=rest).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("valued").alias("valued"), F.sum("total").alias("total"))
    return found.select("user_id", "n", F.when(F.col("valued") > 0, F.round("total", 4)).alias("total"))
