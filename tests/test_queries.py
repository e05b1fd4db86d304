"""Every query of the library, outside the training-data operators, against DuckDB."""

import pytest
from compare import rows

import __spark_entry__  # noqa: F401  registers the queries
from millrace.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert rows(found.toPandas()) == rows(duck.sql(SQL[name]).df())
    else:
        assert found.count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_approximate_values(spark, duck, sf_dir):
    exact = dict(duck.sql("SELECT l_returnflag, count(DISTINCT l_orderkey) FROM lineitem GROUP BY 1").fetchall())
    for r in QUERIES["agg_approx"](spark, sf_dir).collect():
        assert abs(r["orders_sketch"] - exact[r["l_returnflag"]]) <= 0.1 * exact[r["l_returnflag"]]


def test_append_stream_is_part_of_the_batch(spark, sf_dir):
    batch = {(r["start"], r["event_type"], r["n"]) for r in QUERIES["events_tumbling"](spark, sf_dir).collect()}
    stream = {(r["start"], r["event_type"], r["n"]) for r in QUERIES["stream_tumbling"](spark, sf_dir).collect()}
    assert stream <= batch and len(stream) > 0.9 * len(batch)
