"""Sharding by rendezvous hashing.

Every shard draws a number for a record's key from a hash of both, and the record goes
to the shard with the highest score. A shard of weight w has the score -w / ln(u), so it
gets a share of the keys in proportion to w. A further shard can only win records for
itself: no record moves between the shards that were there.

Only the key and the shards decide, so no data is moved to find a record's shard. The
slot is its place in its shard: rows are dealt into cells by a hash of key, size and checksum, cells are
counted, and a record's slot is the count of the cells before its own plus its rank in its cell. A cell of
a thousandth of all rows or more holds rows that are alike; it is dealt again by the tasks that read
them. A shard is never sorted in one task, nor are the rows of one key.

Defined results: a null key is a key of its own; rows that repeat a key go to one shard and
get different slots; a null text has 0 bytes and checksum 0. An empty table gives none.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written

#: Cells of each shard, for slots, and those that a cell of many equal rows is dealt into.
CELLS, PARTS = 4096, 256


def _score(key: Column, shard: int, weight: float, salt: str) -> Column:
    # 52 bits and a half, so that u is never 0 or 1
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(salt), key, F.lit(shard)), 12)
    return -F.lit(float(weight)) / F.ln((draw + F.lit(0.5)) / F.lit(float(2**52)))


def rendezvous(key: Column, weights: Sequence[float], salt: str = "millrace") -> Column:
    """Number of the shard that wins the key; ties go to the higher number. A weight of 0 wins nothing."""
    scores = [F.struct(_score(key, s, w, salt).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("no shard has a weight")
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def _dealt(placed: DataFrame, hot: int) -> DataFrame:
    """placed, a written table, with part 0 but for cells of many rows, which keep their parts."""
    cells = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))  # CELLS rows a shard at most
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = cells.where(F.col("n") >= max(hot, total // 1000)).select((F.col("shard") * CELLS + F.col("cell")).alias("at")).collect()  # a thousand at most
    is_large = (F.col("shard") * CELLS + F.col("cell")).isin([r["at"] for r in large]) if large else F.lit(False)
    return placed.withColumn("part", F.when(is_large, F.col("part")).otherwise(F.lit(0)))


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: float = 1.0, text: str = "text", key: str = "doc_id", salt: str = "millrace", hot: int = 1000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    grown_shard is the shard once another of weight `grown` has been added. hot: rows of a cell that is dealt again, at least.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    cell = F.pmod(F.xxhash64(F.lit(salt), F.lit("cell"), "doc_id", "size", "text_crc32"), F.lit(CELLS)).cast("int")
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS))
    placed = rows.select("*", rendezvous(F.col("doc_id"), weights, salt).alias("shard"), rendezvous(F.col("doc_id"), [*weights, grown], salt).alias("grown_shard"), cell.alias("cell"), part.alias("part"))
    placed = _dealt(written(placed, "placed"), hot)
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("shard", "cell", "part").agg(F.count("*").alias("n"))
    cells = cells.select("shard", "cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "cell", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(cells, ["shard", "cell", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("rank")).cast("long").alias("slot"), "grown_shard",
    )
