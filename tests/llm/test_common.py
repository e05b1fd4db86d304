import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from millrace.llm.common import Bitmap, Recent, join_groups, without


def test_bitmap_holds_all_that_was_put_in(spark):
    rng = np.random.default_rng(1)
    numbers = rng.integers(-(2**63), 2**63 - 1, 3000)
    bits = Bitmap(spark.createDataFrame([(int(x),) for x in numbers], "x long"), "x")
    assert bits.holds(numbers).all()
    assert bits.holds(rng.integers(-(2**63), 2**63 - 1, 20000)).mean() < 0.1
    full = Bitmap(spark.range(1000), "id", most=64)
    assert full.holds(rng.integers(-(2**63), 2**63 - 1, 100)).all()
    assert not Bitmap(spark.range(0), "id").holds(numbers).any()


def test_bitmap_comes_without_objects(spark):
    """The driver holds no Python object for a word of bits: of 50,001 words that would be more than 10 MB."""
    numbers = spark.range(100_000).select(F.xxhash64("id").alias("x"))
    tracemalloc.start()
    try:
        bits = Bitmap(numbers, "x")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(bits.words) == 50_001 and peak < 4e6
    assert bits.holds(np.array([r["x"] for r in numbers.limit(1000).collect()])).all()


def test_join_of_large_and_small_groups(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 7 + 1).alias("g"))
    groups = rows.where("g <> 3").groupBy("g").agg(F.count("*").alias("n"))
    found = join_groups(rows, groups, ["g"], "n")
    assert found.count() == 5000 and found.where("n is null").count() == rows.where("g = 3").count()
    assert join_groups(rows, groups, ["g"], "n", "inner").count() == rows.where("g <> 3").count()


def test_without(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, t string")
    for most in (0, 10):
        assert {r["t"] for r in without(docs, docs.where("doc_id = 2").select("doc_id"), "doc_id", most).collect()} == {"a", "c"}
        assert {r["t"] for r in without(docs, docs.where("doc_id is null").select("doc_id"), "doc_id", most).collect()} == {"a", "b"}


def test_recent_is_bounded_and_right():
    asked = []
    memo = Recent(lambda k: asked.append(k) or k * 2, 10)
    for k in [*range(100), *range(95, 100)]:
        assert memo[k] == 2 * k and len(memo) <= 10 and len(memo.old) <= 10
    assert len(asked) == 100
