"""Streams with processors that keep several kinds of state for each key, in the RocksDB store.

`Days` keeps lists and closes a key by a timer of event time; `Seen` keeps a map whose entries have a time to live. A stream
that is started again with its checkpoint goes on with its state.

Each call of a processor and of its state costs more than many rows do. So a key of `Days` is a day and a bucket of users, not a user's day, and an entry
of its list holds all of a call's rows as arrays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.registry import query
from millrace.sources.tables import table
from millrace.streaming.events import run, stream, timely

_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: State that goes by the clock asks for batches without data without end.
_BY_THE_CLOCK = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def rocks(spark: SparkSession, by_the_clock: bool = False) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    wanted = _ROCKS | (_BY_THE_CLOCK if by_the_clock else {})
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def median(values: list[float]) -> float | None:
    values = sorted(values)
    n = len(values)
    return None if not n else values[n // 2] if n % 2 else (values[n // 2 - 1] + values[n // 2]) / 2


def top(counts: dict[str, int]) -> str | None:
    """The most frequent; of equals the first in order."""
    return min(counts, key=lambda t: (-counts[t], t.encode()), default=None)


def keyed(events: DataFrame) -> DataFrame:
    """events with keys that are never null, as processors mix up null numbers: whether there is a user, and which."""
    return events.withColumn("known", F.col("user_id").isNotNull()).withColumn("user", F.coalesce("user_id", F.lit(0).cast("long")))


def _user(key: tuple) -> int | None:
    return key[1] if key[0] else None


class Days(StatefulProcessor):
    """Key: bucket of users, and day. A list of the events that each call has brought, nulls too; the users' days are given and the list is cleared once the watermark has passed the day."""

    RESULT = "user_id long, day timestamp, n long, middle double, top_type string"
    HELD = "known array<boolean>, user array<long>, event_type array<string>, value array<double>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", self.HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.events.exists():
            self.handle.registerTimer(int((key[1] + timedelta(days=1)).timestamp() * 1000))
        for f in rows:
            kinds, values = (f[c].astype(object).where(f[c].notna(), None).tolist() for c in ("event_type", "value"))
            self.events.appendValue((f["known"].tolist(), f["user"].tolist(), kinds, values))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        users: dict[tuple, tuple[list, Counter]] = {}
        for columns in self.events.get():
            for known, user, kind, value in zip(*columns, strict=True):
                values, kinds = users.setdefault((known, user), ([], Counter()))
                values.append(value)
                if kind is not None:
                    kinds[kind] += 1
        self.events.clear()
        yield pd.DataFrame({
            "user_id": pd.array([_user(u) for u in users], dtype="Int64"),
            "day": [key[1]] * len(users),
            "n": [len(values) for values, _ in users.values()],
            "middle": pd.array([median([v for v in values if v is not None]) for values, _ in users.values()], dtype="Float64"),
            "top_type": pd.array([top(kinds) for _, kinds in users.values()], dtype="object"),
        })

    def close(self) -> None:
        pass


def open_days(spark: SparkSession, state: str) -> DataFrame:
    """What Days would give for the days that are still open in a checkpoint's state."""
    held = spark.read.format("statestore").option("stateVarName", "events").load(state)
    events = held.select("key.day", F.inline(F.arrays_zip(*(F.col(f"list_element.{c}").alias(c) for c in ("known", "user", "event_type", "value")))))
    days = events.groupBy("known", "user", "day").agg(F.count("*").alias("n"), F.median("value").alias("middle"), F.mode("event_type", True).alias("top_type"))
    return days.select(F.when(F.col("known"), F.col("user")).alias("user_id"), "day", "n", "middle", "top_type")


#: Events of a bucket of users, about, if all are of one day.
BUCKET = 1 << 15


def user_days(events: DataFrame, buckets: int = 16) -> DataFrame:
    """The stream of days of a stream of events. buckets: of users, whose number should grow with the events'; a checkpoint belongs to one number."""
    days = keyed(events.where("ts is not null")).select("known", "user", "event_type", "value", "ts", F.date_trunc("day", "ts").alias("day"))
    dealt = days.withColumn("bucket", F.pmod(F.xxhash64("known", "user"), F.lit(buckets)))
    return dealt.groupBy("bucket", "day").transformWithStateInPandas(Days(), Days.RESULT, "append", "eventTime")


@query("""
WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, value, event_type FROM events WHERE ts IS NOT NULL),
a AS (SELECT user_id, day, count(*) AS n, round(median(value), 6) AS middle FROM e GROUP BY ALL),
c AS (SELECT user_id, day, event_type, count(*) AS k FROM e WHERE event_type IS NOT NULL GROUP BY ALL),
t AS (SELECT user_id, day, event_type FROM c QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY k DESC, event_type) = 1)
SELECT a.user_id, a.day, n, middle, event_type AS top_type FROM a LEFT JOIN t ON a.user_id IS NOT DISTINCT FROM t.user_id AND a.day = t.day
""")
def stream_user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's days: number of events, median value, most frequent type."""
    buckets = -(-table(spark, sf_dir, "events").count() // BUCKET) or 1
    with rocks(spark):
        found = run(user_days(timely(spark, sf_dir), buckets), rest=lambda state: open_days(spark, state))
    return found.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round("middle", 6).alias("middle"), "top_type")


class Seen(StatefulProcessor):
    """Key: known and user. A type is given the first time it is seen, and again once it has been forgotten."""

    RESULT = "user_id long, event_type string"

    def __init__(self, live_ms: int):
        self.live_ms = live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.types = handle.getMapState("types", "event_type string", "first long", self.live_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for f in rows:
            for kind in f["event_type"].unique():
                kind = None if pd.isna(kind) else kind
                name = "null" if kind is None else f"type {kind}"  # keys of a map aren't null
                if not self.types.containsKey((name,)):
                    self.types.updateValue((name,), (timerValues.getCurrentProcessingTimeInMs(),))
                    new.append(kind)
        yield pd.DataFrame({"user_id": pd.array([_user(key)] * len(new), dtype="Int64"), "event_type": pd.array(new, dtype="object")})

    def close(self) -> None:
        pass


def first_seen(events: DataFrame, live_ms: int) -> DataFrame:
    return keyed(events).select("known", "user", "event_type").groupBy("known", "user").transformWithStateInPandas(Seen(live_ms), Seen.RESULT, "append", "processingTime")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of each user, as they are first seen; they are forgotten after a week of the clock."""
    with rocks(spark, by_the_clock=True):
        return run(first_seen(stream(spark, sf_dir), 7 * 24 * 60 * 60 * 1000))
