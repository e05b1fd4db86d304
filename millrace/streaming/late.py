"""Events that come after the watermark has closed their window: counted, and kept beside those on time.

Events arrive in deliveries, files that are put into a folder one after another. Two streams read the folder as files come:

- `windows` counts events by window with Spark's own watermark, which drops what is late. Its progress tells how many rows it dropped.
- `split` gives every event with its delivery and whether it is `late`, that is, whether the watermark of the deliveries before has
  passed the end of its window. It keeps each delivery's watermark beside the delivery's rows, both in folders with the batch's number: a batch that
  is run again writes the same again, and a stream that is started again goes on where it stopped.

So events on time and late ones are all events, and adding late ones to a closed window amends it. Events without a time are never late and in no window.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.registry import query
from millrace.sources.tables import discard, scratch, table
from millrace.streaming.events import _start


class Arrivals:
    """A folder that deliveries are put into, and the streams over it. delay: seconds that the watermark waits."""

    def __init__(self, spark: SparkSession, schema: StructType, width: str = "1 hour", delay: int = 3600, top: str | None = None):
        self.spark, self.schema, self.width, self.delay = spark, schema, width, delay
        self.top = top or scratch(spark)
        self.dropped = 0

    def put(self, rows: DataFrame) -> None:
        """A delivery. It is whole before streams see it: they read what the writer has committed."""
        rows.select(self.schema.names).write.mode("append").parquet(f"{self.top}/incoming")

    def _stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("pathGlobFilter", "*.parquet").parquet(f"{self.top}/incoming")

    def windows(self) -> None:
        """Count what has come since the last call; rows that Spark dropped are added to `dropped`."""
        counts = self._stream().withWatermark("ts", f"{self.delay} seconds").groupBy(F.window("ts", self.width).alias("w")).agg(F.count("*").alias("n")).select(_start(), "n")
        out = counts.writeStream.option("checkpointLocation", f"{self.top}/windows").format("parquet").option("path", f"{self.top}/closed").outputMode("append")
        done = out.trigger(availableNow=True).start()
        done.awaitTermination()
        self.dropped += sum(s["numRowsDroppedByWatermark"] for p in done.recentProgress for s in p["stateOperators"])

    def counted(self) -> DataFrame:
        """start, n of the windows, closed or still open in the state."""
        closed = self.spark.read.schema("start string, n long").parquet(f"{self.top}/closed")
        held = self.spark.read.format("statestore").load(f"{self.top}/windows")
        return closed.unionByName(held.select(_start("key.w" if "w" in held.schema["key"].dataType.names else "key.window"), F.col("value.count").alias("n")))

    def _mark(self, batch: int) -> int | None:
        """Milliseconds of the watermark that a batch leaves behind, none before the first one with a time."""
        return self.spark.read.schema("mark long").parquet(f"{self.top}/marks/batch={batch}").first()[0] if batch >= 0 else None

    def _put_split(self, batch: DataFrame, n: int) -> None:
        mark = self._mark(n - 1)
        end = F.unix_micros(F.window("ts", self.width)["end"])
        late = F.lit(False) if mark is None else F.coalesce(end <= mark * 1000, F.lit(False))
        timed = batch.where("ts is not null").withColumn("late", late)
        rows = timed.unionByName(batch.where("ts is null").withColumn("late", F.lit(False)))
        rows.write.mode("overwrite").parquet(f"{self.top}/split/batch={n}")
        last = self.spark.read.schema(self.schema).parquet(f"{self.top}/split/batch={n}").agg(F.unix_millis(F.max("ts"))).first()[0]
        marks = [x for x in (mark, None if last is None else last - 1000 * self.delay) if x is not None]
        self.spark.createDataFrame([(max(marks, default=None),)], "mark long").coalesce(1).write.mode("overwrite").parquet(f"{self.top}/marks/batch={n}")

    def split(self) -> None:
        """Deal out what has come since the last call."""
        self._stream().writeStream.option("checkpointLocation", f"{self.top}/splitting").foreachBatch(self._put_split).trigger(availableNow=True).start().awaitTermination()

    def rows(self) -> DataFrame:
        """The events with their `batch` (from 0) and whether they were `late`."""
        return self.spark.read.schema(StructType([*self.schema.fields]).add("late", "boolean").add("batch", "integer")).parquet(f"{self.top}/split")

    def done(self) -> None:
        """Delete what only the streams need."""
        for name in ("incoming", "windows", "splitting", "marks"):
            discard(self.spark, f"{self.top}/{name}")


def deliveries(events: DataFrame, parts: int = 4) -> DataFrame:
    """events with their `delivery`: the span of time is dealt into equal parts, and some events of each come one or two deliveries later."""
    ends = events.agg(F.min(F.unix_micros("ts")).alias("first"), F.max(F.unix_micros("ts")).alias("last"))
    part = F.coalesce(F.expr(f"((unix_micros(ts) - first) * {parts}) div (last - first + 1)"), F.lit(0))
    held = F.when(F.col("event_id") % 50 == 7, 2).when(F.col("event_id") % 20 == 3, 1).otherwise(0)
    return events.crossJoin(F.broadcast(ends)).withColumn("delivery", (part + held).cast("int")).drop("first", "last")  # one row of ends


def _arrive(spark: SparkSession, sf_dir: str, parts: int = 4) -> Iterator[tuple[Arrivals, int]]:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    arrivals = Arrivals(spark, events.schema)
    dealt = deliveries(events, parts)
    for k in range(parts + 2):
        arrivals.put(dealt.where(F.col("delivery") == k))
        yield arrivals, k


_SPLIT = """
WITH x AS (SELECT min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM events),
e AS (
  SELECT *, CAST(coalesce(((epoch_us(ts) - first) * 4) // (last - first + 1), 0) + CASE WHEN event_id % 50 = 7 THEN 2 WHEN event_id % 20 = 3 THEN 1 ELSE 0 END AS INTEGER) AS delivery
  FROM events, x),
m AS (SELECT delivery, max(date_trunc('millisecond', max(ts))) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS mark FROM e GROUP BY delivery),
s AS (SELECT e.*, coalesce(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= mark, false) AS late FROM e JOIN m USING (delivery))
"""


@query(_SPLIT + "SELECT event_id, delivery, late FROM s")
def stream_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in six deliveries, some of which come too late for their window."""
    for arrivals, _ in _arrive(spark, sf_dir):
        arrivals.split()
    arrivals.done()
    return arrivals.rows().select("event_id", F.col("batch").alias("delivery"), "late")


@query(_SPLIT + """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) FILTER (WHERE NOT late) AS on_time, count(*) FILTER (WHERE late) AS late
FROM s WHERE ts IS NOT NULL GROUP BY ALL
""")
def stream_late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as Spark's watermark closed them, and beside each the events that came too late for it."""
    for arrivals, _ in _arrive(spark, sf_dir):
        arrivals.windows()
        arrivals.split()
    late = arrivals.rows().where("late").groupBy(F.date_format(F.window("ts", "1 hour")["start"], "yyyy-MM-dd HH:mm:ss").alias("start")).agg(F.count("*").alias("late"))
    counted = arrivals.counted()
    path = f"{arrivals.top}/both"
    both = counted.join(late, "start", "full").select("start", F.coalesce("n", F.lit(0)).alias("on_time"), F.coalesce("late", F.lit(0)).alias("late"))
    both.write.parquet(path)
    arrivals.done()
    return spark.read.schema(both.schema).parquet(path)


