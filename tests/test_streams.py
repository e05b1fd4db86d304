"""Streams over folders of many files, in any order, with nulls and with exact gaps: what a stream gives is what SQL gives over the whole table."""

import pytest
from compare import rows
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from millrace.registry import QUERIES, SQL
from millrace.streaming import events as streams

NAMES = ["stream_tumbling_complete", "stream_tumbling", "stream_sessions", "stream_deduplicated", "stream_join", "stream_custom_state", "stream_user_days", "stream_first_seen", "stream_late_events", "stream_late_windows"]


@pytest.fixture(scope="module")
def many_files(spark, sf_dir, tmp_path_factory):
    """Each file spans the whole range of time."""
    top = tmp_path_factory.mktemp("many")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(23).write.parquet(f"{top}/events.parquet")
    return str(top)


@pytest.fixture(scope="module")
def odd_rows(spark, tmp_path_factory):
    """Nulls in every column but the id, gaps of exactly 30 minutes, and events of one time."""
    top = tmp_path_factory.mktemp("odd")
    at = lambda minutes: f"timestamp_ntz'2024-01-01 10:00:00' + interval {minutes} minutes"
    made = [(1, at(0), "1", "'view'", "1.5"), (2, at(30), "1", "'purchase'", "null"), (3, at(61), "1", "'view'", "2.0"), (4, at(61), "1", "'purchase'", "3.0")]
    made += [(5, at(5), "null", "'view'", "4.0"), (6, at(5), "null", "null", "null"), (7, at(4000), "2", "'view'", "null"), (8, at(4030), "2", "'view'", "null")]
    sql = " union all ".join(f"select {i}L event_id, {ts} ts, cast({u} as bigint) user_id, cast({kind} as string) event_type, cast({v} as double) value, cast(null as string) props" for i, ts, u, kind, v in made)
    spark.sql(sql).repartition(3).write.parquet(f"{top}/events.parquet")
    return str(top)


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
    spark.conf.set("spark.sql.shuffle.partitions", before[1])


def expected(duck, name, folder):
    from duckdb import connect

    con = connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return rows(con.sql(SQL[name]).df())


@pytest.mark.parametrize("name", NAMES)
def test_unordered_files(spark, duck, many_files, partitions, name):
    assert rows(QUERIES[name](spark, many_files).toPandas()) == expected(duck, name, many_files)


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, duck, odd_rows, name):
    assert rows(QUERIES[name](spark, odd_rows).toPandas()) == expected(duck, name, odd_rows)


def test_exact_gap(spark, odd_rows):
    """A gap of exactly 30 minutes belongs to the session, one of 31 doesn't."""
    found = QUERIES["stream_sessions"](spark, odd_rows).where("user_id = 1").collect()
    assert sorted((r["start"], r["n"]) for r in found) == [("2024-01-01 10:00:00", 2), ("2024-01-01 11:01:00", 2)]


def test_disorder(spark, tmp_path):
    """Files in order of time have none; of files in any order, the worst counts."""
    import time

    row = "select 1L event_id, timestamp_ntz'2024-01-01 00:00:00' + interval {} seconds ts"
    for k, seconds in enumerate((0, 100, 40, 200)):
        spark.sql(row.format(seconds)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        if k == 1:
            assert streams.disorder(spark.read.parquet(f"{tmp_path}/events.parquet")) == 1
        time.sleep(0.02)
    assert streams.disorder(spark.read.parquet(f"{tmp_path}/events.parquet")) == 61
    assert streams.disorder(spark.read.parquet(f"{tmp_path}/events.parquet").where("event_id = 0")) == 1


def test_late_events_are_planted(spark, sf_dir):
    """Some are late, all are there, and Spark dropped none that isn't late."""
    from millrace.streaming.late import _arrive

    for arrivals, _ in _arrive(spark, sf_dir):
        arrivals.windows()
        arrivals.split()
    found = arrivals.rows()
    late = found.where("late").count()
    assert found.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count() and late > 20
    assert found.select("batch").distinct().count() == 6
    on_time = arrivals.counted().groupBy().sum("n").first()[0]
    assert on_time + late == found.count() and 0 < arrivals.dropped <= late


def test_split_goes_on_where_it_stopped(spark, sf_dir, monkeypatch):
    """A batch that fails once its rows are written is run again, and gives the same."""
    from millrace.streaming import late

    found = []
    for broken in (False, True):
        for arrivals, k in late._arrive(spark, sf_dir):
            if broken and k == 2:
                put = late.Arrivals._put_split

                def fail(self, batch, n):
                    put(self, batch, n)
                    raise RuntimeError("lost")

                monkeypatch.setattr(late.Arrivals, "_put_split", fail)
                with pytest.raises(Exception, match="lost"):
                    arrivals.split()
                monkeypatch.setattr(late.Arrivals, "_put_split", put)
                arrivals = late.Arrivals(spark, arrivals.schema, top=arrivals.top)
            arrivals.split()
        found.append(rows(arrivals.rows().select("event_id", "batch", "late").toPandas()))
    assert found[0] == found[1]


def _restarted(spark, make, folder, parts, schema):
    """What a stream gives after each part has come, started anew each time."""
    out = []
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(schema).parquet(f"{folder}/in")
        make(source).writeStream.option("checkpointLocation", f"{folder}/state").format("parquet").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
        out.append(spark.read.parquet(f"{folder}/out").toPandas())
    return out


def test_days_go_on_from_their_checkpoint(spark, sf_dir, tmp_path):
    from millrace.streaming import state

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    cut = [F.col("ts") < "2024-01-10 12:00:00", F.col("ts").between("2024-01-10 12:00:00", "2024-01-20 18:00:00"), F.col("ts") > "2024-01-20 18:00:00"]
    with state.rocks(spark):
        _restarted(spark, lambda s: state.user_days(s.withWatermark("ts", "1 hour")), str(tmp_path), [events.where(c) for c in cut], events.schema)
    closed = spark.read.schema(state.Days.RESULT).parquet(f"{tmp_path}/out")
    found = closed.unionByName(state.open_days(spark, f"{tmp_path}/state")).groupBy("user_id", "day").count()
    assert found.where("count > 1").isEmpty()
    assert closed.unionByName(state.open_days(spark, f"{tmp_path}/state")).groupBy().sum("n").first()[0] == events.count() and closed.count() > 300


def test_what_is_seen_is_forgotten_after_its_time(spark, tmp_path):
    from millrace.streaming import state

    row = spark.createDataFrame([(1, "view"), (None, None)], "user_id long, event_type string")
    for live, expected in ((60 * 60 * 1000, [2, 2]), (1, [2, 4])):
        with state.rocks(spark, by_the_clock=True):
            found = _restarted(spark, lambda s, live=live: state.first_seen(s, live), f"{tmp_path}/{live}", [row, row], row.schema)
        assert [len(f) for f in found] == expected


def test_median_and_top():
    from millrace.streaming.state import median, top

    assert (median([]), median([3.0]), median([4.0, 1.0]), median([5.0, 1.0, 2.0])) == (None, 3.0, 2.5, 2.0)
    assert (top({}), top({"b": 2, "a": 2, "c": 1})) == (None, "a")


def test_days_keep_a_key_for_each_bucket(spark, odd_rows, tmp_path):
    """State and calls grow with buckets and days, not with users; the null user and user 0 stay apart."""
    from millrace.streaming import state

    events = spark.createDataFrame([(k % 40 or None, "view", float(k)) for k in range(400)] + [(0, None, None)], "user_id long, event_type string, value double")
    events = events.selectExpr("*", "timestamp'2024-01-01 10:00:00' + make_dt_interval(int(coalesce(value, 0)) % 2) ts")
    with state.rocks(spark):
        _restarted(spark, lambda s: state.user_days(s.withWatermark("ts", "9 days"), 3), str(tmp_path), [events.where("value < 200"), events.where("value >= 200 or value is null")], events.schema)
    held = spark.read.format("statestore").option("stateVarName", "events").load(f"{tmp_path}/state")
    assert 0 < held.select("key").distinct().count() <= 6
    found = {(r["user_id"], r["day"].day): (r["n"], r["middle"], r["top_type"]) for r in state.open_days(spark, f"{tmp_path}/state").collect()}
    assert len(found) == 41 and found[0, 1] == (1, None, None) and found[None, 1] == (10, 180.0, "view") and found[1, 2] == (10, 181.0, "view")
