"""Exact deduplication by an extendible-hash index on shared files.

Texts are equal when they are identical after deleting every blank character
([\\x20\\x09-\\x0D]). Steps:

1. Each task writes (row, key, digest) to the index on shared files. The key is a
   64-bit hash of the normalised text.
2. The directory: distinct keys are counted by key prefix, and a bucket over its
   capacity is split on the next bit. When its depth passes the directory's, the
   directory doubles. A bucket is therefore a range of keys.
3. Texts whose key may occur more than once, by a bitmap of fixed size over such keys, go
   to the task that owns their bucket. Equal texts of a task are merged beforehand, and then those
   of a few tasks each, so an owner gets SALTS copies of a text at most, however often it occurs. The owner
   walks its keys in order, chains different texts of one key, and compares bytes. A
   bitmap that fills up lets more texts through; it never holds back one that is needed.
4. Rows get their group's verdict. Groups with a large share of all rows are broadcast.

Defined results: a null text counts as empty, and empty or blank texts form one group.
Of equal texts the row with most code points stays, then the smallest id; a null id
comes after all others. Rows repeated under one id count each in group_size and share
the verdict. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BLANKS, Bitmap, in_arrow, join_groups, map_batches, slices, unused, without, written

_DROP = BLANKS.encode()

#: Tasks that merge the copies of one text before its owner does, and bytes of texts that a task holds to merge them.
SALTS, MERGED = 16, 64 << 20

#: Deepest directory: 2 ** 20 entries of 4 bytes. Fuller buckets stay as they are.
MAX_DEPTH = 20


def _keys(text: str | None, bits: int) -> tuple[bytes, int]:
    norm = (text or "").encode("utf-8", "surrogatepass").translate(None, _DROP)
    return norm, (xxhash.xxh64_intdigest(norm) >> (64 - bits) << (64 - bits)) - 2**63


def _fingerprints(rows: DataFrame, bits: int) -> DataFrame:
    def make():
        def step(c: dict) -> dict:
            both = [_keys(t, bits) for t in c["text"]]
            return {
                "doc_id": c["doc_id"],
                "key": [k for _, k in both],
                "digest": [hashlib.sha256(n).hexdigest() for n, _ in both],
                "n_chars": [len(t or "") for t in c["text"]],
            }

        return step

    return map_batches(rows, make, "doc_id long, key long, digest string, n_chars long")


def build_directory(counts: DataFrame, capacity: int) -> np.ndarray:
    """Bucket number for each key prefix. counts: one row for each distinct key.

    Only counts for each prefix come to the driver: 2 ** MAX_DEPTH numbers at most.
    """
    prefix = F.shiftright(F.col("key"), 64 - MAX_DEPTH) + 2 ** (MAX_DEPTH - 1)
    fine = np.zeros(2**MAX_DEPTH, dtype=np.int64)
    coarse = 8  # levels are counted only as deep as some bucket needs them
    while True:
        level = counts.groupBy(F.shiftright(prefix, MAX_DEPTH - coarse).cast("int").alias("p")).count()
        found = level.toPandas()
        cells = np.zeros(2**coarse, dtype=np.int64)
        cells[found["p"].to_numpy(dtype=np.int64)] = found["count"].to_numpy(dtype=np.int64)
        if coarse == MAX_DEPTH or cells.max() <= capacity:
            fine = cells
            break
        coarse = min(MAX_DEPTH, coarse + 4)

    sums = np.concatenate([[0], np.cumsum(fine)])
    depth = 0
    directory = np.zeros(1, dtype=np.int32)  # starts as one bucket
    local = [0]
    start = [0]
    todo = [0]
    while todo:
        b = todo.pop()
        width = 2 ** (coarse - local[b])
        if sums[start[b] + width] - sums[start[b]] <= capacity or local[b] == coarse:
            continue
        if local[b] == depth:  # double the directory
            directory, depth = np.repeat(directory, 2), depth + 1
        local[b] += 1
        new = len(local)
        local.append(local[b])
        start.append(start[b] + width // 2)
        span = 2 ** (depth - local[b])
        at = start[new] >> (coarse - depth)
        directory[at : at + span] = new
        todo += [b, new]
    return directory


_TEXT = pa.schema([("owner", pa.int32()), ("key", pa.int64()), ("norm", pa.binary()), ("n_chars", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64())])
_TEXT_DDL = "owner int, key long, norm binary, n_chars long, doc_id long, size long"


class _Merged:
    """Equal texts as one: the best row's characters and id, and how many rows there are. What is held is bounded in bytes."""

    def __init__(self):
        self.found: dict[tuple, list] = {}
        self.bytes = 0

    def add(self, owner: int, key: int, norm: bytes, best: tuple, n: int) -> None:
        known = self.found.get((key, norm))
        if known:
            known[1], known[2] = min(known[1], best), known[2] + n
        else:
            self.found[key, norm] = [owner, best, n]
            self.bytes += len(norm) + 300

    def flush(self) -> pa.RecordBatch:
        rows = self.found
        columns = ([v[0] for v in rows.values()], [k for k, _ in rows], [n for _, n in rows], [-v[1][0] for v in rows.values()], [None if v[1][1] else v[1][2] for v in rows.values()], [v[2] for v in rows.values()])
        out = pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, _TEXT, strict=True)], schema=_TEXT)
        self.__init__()
        return out


def _texts(rows: DataFrame, bits: int, directory: np.ndarray, contested: Bitmap) -> DataFrame:
    """Owner, key and bytes of each text that may have a copy; the equal texts of a task are one row."""
    depth = int(np.log2(len(directory)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _Merged()
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                keyed = [_keys(t, bits) for t in texts]
                needed = contested.holds(np.array([k for _, k in keyed], dtype=np.int64))
                for i, t, (norm, key), need in zip(part.column(0).to_pylist(), texts, keyed, needed, strict=True):
                    if need:
                        merged.add(int(directory[(key + 2**63) >> (64 - depth)]), key, norm, (-len(t or ""), i is None, i or 0), 1)
                if merged.bytes > MERGED:
                    yield merged.flush()
        if merged.found:
            yield merged.flush()

    return in_arrow(rows, run, _TEXT_DDL)


def _fewer(texts: DataFrame) -> DataFrame:
    """Copies from many tasks as SALTS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _Merged()
        for batch in batches:
            for part in slices(batch):
                for owner, key, norm, chars, i, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    merged.add(owner, key, norm, (-chars, i is None, i or 0), n)
                if merged.bytes > MERGED:
                    yield merged.flush()
        if merged.found:
            yield merged.flush()

    salted = texts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return in_arrow(salted.repartition("key", "salt").drop("salt"), run, _TEXT_DDL)


_GROUP = pa.schema([("key", pa.int64()), ("digest", pa.string()), ("chain", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive in order of key. The chain of one key is held, nothing else."""
    chain: list[list] = []  # [bytes, best, rows]
    at = None
    done: list[tuple] = []

    def close() -> None:
        for k, (norm, best, n) in enumerate(chain):
            done.append((at, hashlib.sha256(norm).hexdigest(), k, None if best[1] else best[2], n))
        chain.clear()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*done, strict=True), _GROUP, strict=True)], schema=_GROUP)
        done.clear()
        return out

    for batch in batches:
        for i in range(batch.num_rows):
            key, norm, chars, doc, n = (batch.column(k)[i].as_py() for k in range(1, 6))
            if key != at:
                close()
                at = key
            best = (-chars, doc is None, doc or 0)
            for entry in chain:
                if entry[0] == norm:
                    entry[1], entry[2] = min(entry[1], best), entry[2] + n
                    break
            else:
                chain.append([norm, best, n])
        if len(done) > 4096:
            yield flush()
    close()
    if done:
        yield flush()


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", *, key_bits: int = 64, bucket: int = 4096, bitmap: int = Bitmap.MOST) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    bucket: distinct keys that a bucket of the index holds; more than 65,536 buckets
    of that size raise it, which bounds the directory. bitmap: the most bits of the
    bitmap. key_bits under 64 make keys collide, for tests.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    index = written(_fingerprints(rows, key_bits), "keys")
    counts = written(index.groupBy("key").agg(F.count("*").alias("n")), "counts")
    directory = build_directory(counts, max(bucket, counts.count() // 65536))
    owned = _texts(rows, key_bits, directory, Bitmap(counts.where("n > 1").select("key"), "key", bitmap))
    groups = written(in_arrow(_fewer(owned).repartition("owner").sortWithinPartitions("key"), _own, "key long, digest string, chain int, keep_id long, group_size long"), "groups")
    found = join_groups(index, groups, ["key", "digest"], "group_size")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns: one row for each normalised text.

    Which one is decided by code points, then id, then text. Rows that share an id, or have none, are told
    apart by their texts' digests; of rows equal in both id and text any one is returned.
    """
    verdicts = exact_groups(docs, text, key, **options).groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    verdicts = written(verdicts.agg(F.max("kept").alias("_kept"), F.count("*").alias("_rows")), "verdicts")
    ids = written(verdicts.groupBy("_id").agg(F.sum("_rows").alias("_rows"), F.max("_kept").alias("_kept")), "ids")
    single = without(docs, ids.where((F.col("_rows") > 1) | ~F.col("_kept")).select("_id"), key)
    repeated = ids.where("_rows > 1").select("_id")
    if repeated.isEmpty():
        return single
    name = unused("_id", docs.columns)
    repeated = repeated.toDF(name)
    repeated = F.broadcast(repeated) if repeated.count() <= 1_000_000 else repeated
    many = docs.join(repeated, docs[key].eqNullSafe(repeated[name]), "left_semi")
    digest = F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "").cast("binary"), 256)
    # one row of each id and text, by partial minima, then those whose text's group keeps that id
    order = F.struct(-F.length(F.coalesce(F.col(text), F.lit(""))), F.col(text))
    one = many.groupBy(F.col(key).cast("long").alias("_id"), digest.alias("_sha")).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), order).alias("_row"))
    stay = verdicts.where("_kept").select(F.col("_id").alias("_kept_id"), F.col("_sha").alias("_kept_sha"))
    again = one.join(stay, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_sha") == F.col("_kept_sha")), "left_semi").select("_row.*")
    return single.unionByName(again)
