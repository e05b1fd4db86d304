import math
import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from millrace.llm.sharding import _dealt, rendezvous, shard_documents


def test_rows_slots_and_growth(docs):
    found = shard_documents(docs, [1.0] * 40).collect()
    sizes = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == sizes
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def _winner(key, weights, salt="millrace"):
    """The shard of the highest score, from hashes chained over salt, key and shard; a null key leaves the hash as it is."""
    best = None
    for shard, weight in enumerate(weights):
        h = xxhash.xxh64_intdigest(salt.encode(), 42)
        h = h if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        u = ((xxhash.xxh64_intdigest(struct.pack("<i", shard), h) >> 12) + 0.5) / 2**52
        best = max(best or (-1, -1), (-weight / math.log(u), shard)) if weight else best
    return best[1]


def test_winning_shards_a_second_way(docs):
    weights = [1.0, 2.5, 0.0, 0.3] * 10
    for r in shard_documents(docs, weights, grown=2.0).collect():
        assert (r["shard"], r["grown_shard"]) == (_winner(r["doc_id"], weights), _winner(r["doc_id"], [*weights, 2.0]))


def test_rows_of_one_key_are_ranked_in_parts(spark):
    """Equal rows, rows without a key, and others: slots have no gaps, and no window holds many of them."""
    rows = spark.range(6000).select(F.when(F.col("id") < 2000, 7).when(F.col("id") > 3000, F.col("id")).alias("doc_id"), F.when(F.col("id") < 2000, "same").otherwise(F.col("id").cast("string")).alias("text"))
    docs = rows.repartition(16)
    found = shard_documents(docs, [1.0] * 4, hot=50)
    slots = {}
    for r in found.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, slots.values())) == 6000 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    placed = docs.select(F.lit(1).alias("shard"), F.coalesce("doc_id", F.lit(-1)).cast("int").alias("cell"), F.spark_partition_id().alias("part"))
    sizes = _dealt(placed, 50).groupBy("cell", "part").count().toPandas()
    assert sizes["count"].max() < 400 and set(sizes[sizes["cell"] > 3000]["part"]) == {0}


def test_equal_keys_meet_and_other_columns_do_not_matter(docs):
    one = {(r["doc_id"], r["shard"]) for r in shard_documents(docs, [1.0] * 40).collect()}
    other = docs.withColumn("text", F.lit("x")).repartition(5)
    assert one == {(r["doc_id"], r["shard"]) for r in shard_documents(other, [1.0] * 40).collect()}
    assert len(one) == len({i for i, _ in one})


def test_weights_decide_the_shares(spark):
    keys = spark.range(40000)
    counts = {r["s"]: r["count"] for r in keys.groupBy(rendezvous(F.col("id"), [1.0, 2.0, 0.0, 5.0]).alias("s")).count().collect()}
    assert set(counts) == {0, 1, 3}
    assert all(abs(counts[s] / 40000 - w / 8) < 0.01 for s, w in ((0, 1), (1, 2), (3, 5)))


def test_growing_moves_only_into_the_new_shard(spark):
    keys = spark.range(20000).select("id", rendezvous(F.col("id"), [1.0] * 9).alias("a"), rendezvous(F.col("id"), [1.0] * 10).alias("b"))
    moved = keys.where("a <> b")
    assert moved.where("b <> 9").isEmpty() and abs(moved.count() / 20000 - 0.1) < 0.015


def test_empty_table(none):
    assert shard_documents(none, [1.0] * 40).count() == 0
