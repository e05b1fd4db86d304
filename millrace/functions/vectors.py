"""Nearest vectors by cosine: an exact search in blocks, and an index of inverted lists with exact ranking of what its lists hold.

Both deal rows into blocks by (list, part of its vectors, part of its queries), which bounds what a task holds at a time, and multiply block by block
inside tasks, in one job. The exact search has one list; the index has CENTRES of them, found by k-means on a sample of bounded size,
and a query looks into the lists whose centres are nearest: into so many that, between vectors of the sample, TARGET of the true neighbours lie in
them. Every vector is in a list.

Vectors that are null, empty or of length 0 have no direction: they are neither found nor answered. Of equal cosines the smaller id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import discard, scratch, table

#: Vectors and queries of a block.
VECTORS, QUERIES = 16384, 2048

#: Vectors that the centres are found from, at most; centres, at most; rounds of k-means.
SAMPLE, CENTRES, ROUNDS = 20_000, 1024, 8

#: Share of neighbours that an index aims at, and vectors of the sample whose neighbours are looked at for that.
TARGET, TRIED = 0.97, 256

_ROW = "vec_id long, unit array<double>"


def units(vectors: DataFrame) -> DataFrame:
    """vec_id and unit, the vector divided by its length, of those that have a direction."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    known = vectors.select("vec_id", e.alias("e")).withColumn("length", length).where("vec_id is not null and length > 0")
    return known.select("vec_id", F.transform("e", lambda x: x / F.col("length")).alias("unit"))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one size as rows."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def best(rows: np.ndarray, c: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest c of each of the rows, ties by other."""
    order = np.lexsort((other, -c, rows))
    first = np.append(True, np.diff(rows[order]) != 0) if len(order) else np.zeros(0, dtype=bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


class Block:
    """The queries of a block, and the best of the vectors that have come so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.units = k, [], []
        self.held = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)

    def add(self, part: pa.RecordBatch) -> None:
        ids, rows = part.column("vec_id").to_numpy(), matrix(part.column("unit"))
        if part.column("query")[0].as_py():
            self.ids.append(ids)
            self.units.append(rows)
        elif self.ids:
            self._meet(ids, rows)

    def _meet(self, other: np.ndarray, rows: np.ndarray) -> None:
        ids, mine = np.concatenate(self.ids), np.concatenate(self.units)
        found = [self.held]
        for s in range(0, len(ids), 256):
            c = mine[s : s + 256] @ rows.T
            c[ids[s : s + 256, None] == other[None, :]] = -2
            least = np.partition(c, -self.k, axis=1)[:, -self.k] if c.shape[1] > self.k else np.full(len(c), -2.0)
            row, col = np.nonzero((c >= least[:, None]) & (c > -2))
            keep = best(row, c[row, col], other[col], self.k)
            found.append((row[keep] + s, c[row, col][keep], other[col][keep]))
        at, c, other = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = best(at, c, other, self.k)
        self.held = at[keep], c[keep], other[keep]

    def result(self) -> pa.RecordBatch:
        at, c, other = self.held
        ids = np.concatenate([np.zeros(0, dtype=np.int64), *self.ids])
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(other), pa.array(c)], names=["vec_id", "other", "c"])


def search(vectors: DataFrame, queries: DataFrame, k: int, sizes: tuple[int, int] = (VECTORS, QUERIES)) -> DataFrame:
    """vec_id, other, cosine of the k most similar vectors of each query among those of its lists. Both have vec_id, unit and list."""
    counted = vectors.groupBy("list").agg(F.ceil(F.count("*") / sizes[0]).cast("int").alias("nv")).join(queries.groupBy("list").agg(F.ceil(F.count("*") / sizes[1]).cast("int").alias("nq")), "list")
    counted = F.broadcast(counted)  # CENTRES lists at most
    part = lambda n: F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = queries.join(counted, "list").select("list", part("nq").alias("q"), every("nv").alias("v"), F.lit(True).alias("query"), "vec_id", "unit")
    held = vectors.join(counted, "list").select("list", part("nv").alias("v"), every("nq").alias("q"), F.lit(False).alias("query"), "vec_id", "unit")
    blocks = asked.unionByName(held).repartition("list", "v", "q").sortWithinPartitions("list", "v", "q", F.desc("query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = Block(k), None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("list", "v", "q", "query")])
            bounds = np.append(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))), batch.num_rows) if batch.num_rows else []
            for a, b in zip(bounds, bounds[1:], strict=False):
                key = tuple(keys[:3, a])
                if key != at:
                    yield block.result()
                    block, at = Block(k), key
                block.add(batch.slice(a, b - a))
        yield block.result()

    found = blocks.mapInArrow(run, "vec_id long, other long, c double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("c"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "other", F.round("c", 6).alias("cosine"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, sizes: tuple[int, int] = (VECTORS, QUERIES)) -> DataFrame:
    """vec_id, other, cosine: every vector is compared with every query."""
    one = lambda rows: units(rows).withColumn("list", F.lit(0))
    return search(one(vectors), one(queries), k, sizes)


def centres(sample: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Directions around which the sample lies, by k-means on the sphere. A centre without vectors goes to the vector that is worst off."""
    draw = np.random.default_rng(seed)
    found = sample[draw.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        c = sample @ found.T
        at, near = c.argmax(axis=1), c.max(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, at, sample)
        length = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(length == 0)
        sums[empty], length[empty] = sample[np.argsort(near)[: len(empty)]], 1
        found = sums / length[:, None]
    return found


def probes_for(sample: np.ndarray, found: np.ndarray, k: int, target: float = TARGET) -> int:
    """Lists to look into so that `target` of the k nearest neighbours of some vectors of the sample, all of it compared, are found."""
    some = sample[:: max(1, len(sample) // TRIED)]
    c = some @ sample.T
    near = np.argsort(-c, axis=1)[:, 1 : k + 1]  # the first is the vector itself
    if not near.size:
        return len(found)
    home = (sample @ found.T).argmax(axis=1)
    rank = np.argsort(np.argsort(-(some @ found.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, home[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


class Index:
    """Inverted lists over vectors. A table of lists lies in the shared folder until close()."""

    def __init__(self, vectors: DataFrame, sample: int = SAMPLE, most: int = CENTRES):
        known = units(vectors)
        n = known.count()
        draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
        some = known.where(draw < int((1 << 30) * min(1.0, 1.2 * sample / max(1, n) + 0.001))).orderBy(draw, "vec_id").limit(sample).select("unit").toArrow()
        self.spark, self.path = vectors.sparkSession, scratch(vectors.sparkSession)
        rows = matrix(some["unit"].combine_chunks()) if len(some) else np.zeros((0, 1))
        self.centres = centres(rows, max(1, min(most, round(n**0.5)))) if len(rows) else rows
        self.probes = probes_for(rows, self.centres, 5) if len(rows) else 1
        self._listed(known, 1).write.parquet(self.path)
        self.lists = self.spark.read.schema(f"{_ROW}, list int").parquet(self.path)

    def _listed(self, rows: DataFrame, probes: int) -> DataFrame:
        """rows once for each of the lists nearest to them."""
        at = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(at):
                    continue
                c = matrix(batch.column("unit")) @ at.T
                n = min(probes, c.shape[1])
                lists = np.argpartition(-c, n - 1, axis=1)[:, :n]
                out = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(lists.ravel(), pa.int32())], names=["vec_id", "unit", "list"])

        return rows.select("vec_id", "unit").mapInArrow(run, f"{_ROW}, list int")

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, sizes: tuple[int, int] = (VECTORS, QUERIES)) -> DataFrame:
        """vec_id, other, cosine of the k most similar vectors in each query's lists, ranked exactly."""
        return search(self.lists, self._listed(units(queries), probes or self.probes), k, sizes)

    def close(self) -> None:
        discard(self.spark, self.path)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact rows that were found."""
    same = exact.join(found.select("vec_id", "other"), ["vec_id", "other"], "left_semi").count()
    return same / max(1, exact.count())


@query("""
WITH v AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id, e.vec_id AS other, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS c FROM v q JOIN v e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)
SELECT vec_id, other, round(c, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, other) <= 5
""")
def fn_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of each query, exactly."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


@query()
def fn_nearest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the index: recall is measured in the tests."""
    vectors = table(spark, sf_dir, "embeddings")
    return Index(vectors).search(vectors.where("vec_id % 100 = 0"))
