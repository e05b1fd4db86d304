"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.sources.tables import scratch

#: Bytes that separate words: [\x20\x09-\x0D]. bytes.split() splits at exactly these.
BLANKS = " \t\n\x0b\x0c\r"

#: Documents, and bytes of them, that a task turns into Python objects at a time.
SLICE, SLICE_BYTES = 512, 4 << 20

#: Rows and bytes of what Spark hands to a Python worker at a time.
BATCH, BATCH_BYTES = 2048, 8 << 20

#: Longest key that a memo keeps.
KEPT = 48


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later steps read it, and lost executors lose nothing."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.millrace_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() gave and that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.millrace_path).getParent()
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return freed memory to the system: workers live on, and what a stage remembered would weigh on the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow in batches of at most BATCH rows and BATCH_BYTES: both JVM and worker hold whole batches. The session keeps smaller bounds of its own."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(conf.get(name).rstrip("b"))
        if now <= 0 or now > most:
            conf.set(name, most)

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(trimmed, schema)


_HELD: dict = {}


def held(key: tuple, make: Callable):
    """make(), kept in this Python worker for its later tasks until something else is asked for."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def slices(batch: pa.RecordBatch, rows: int = SLICE, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows, and of at most so many bytes of text or a single row."""
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")) - at
        n = max(1, min(fit, rows, batch.num_rows - at))
        yield batch.slice(at, n)
        at += n


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, rows: int = SLICE, most: int = SLICE_BYTES) -> DataFrame:
    """Apply a function to record batches of at most `rows` rows and `most` bytes; make() runs once in each task.

    The function returns {column: list or array} of any length.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def column(x, kind: pa.DataType) -> pa.Array:
        return x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, rows, most):
                found = step(part)
                yield pa.RecordBatch.from_arrays([column(found[f.name], f.type) for f in out], schema=out)

    return in_arrow(df, run, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """map_slices with a function of column dictionaries: it gets {column: list}."""

    def made():
        step = make()
        return lambda part: step(part.to_pydict())

    return map_slices(df, made, schema)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, how: str = "left") -> DataFrame:
    """rows joined with one row for each group, where a group may hold a large share of all rows.

    Groups of at least a thousandth of the rows are at most a thousand, so they are
    broadcast; all others meet their rows in a shuffle, where none is large.
    """
    least = max(1000, rows.count() // 1000)
    cold = groups.where(F.col(size) < least)
    hot = groups.where(F.col(size) >= least).withColumn("_hot", F.lit(True))
    tagged = rows.join(F.broadcast(hot), on, "left")
    rest = tagged.where(F.col("_hot").isNull()).select(*rows.columns).join(cold, on, how)
    return tagged.where(F.col("_hot")).drop("_hot").unionByName(rest)


def unused(stem: str, columns: list[str]) -> str:
    """A column name like stem that no column has, in any case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def without(docs: DataFrame, gone: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """The rows of docs whose key isn't in gone's one column. At most a million keys are broadcast; more are shuffled."""
    name = unused("_gone", docs.columns)
    gone = gone.toDF(name)
    gone = F.broadcast(gone) if gone.count() <= most else gone
    return docs.join(gone, docs[key].eqNullSafe(gone[name]), "left_anti")


class Bitmap:
    """A set of whole numbers as bits of their remainders, of bounded size.

    It may hold more than was put in, never less. Once it fills up it holds everything.
    """

    #: The largest prime under 2 ** 27: 16 MB of bits.
    MOST = 134217689

    def __init__(self, numbers: DataFrame, column: str, most: int = MOST):
        self.size = max(64, min(most, 16 * numbers.count() + 1))
        at = F.pmod(F.col(column), F.lit(self.size))
        words = numbers.select(F.floor(at / 32).cast("int").alias("w"), F.expr(f"shiftleft(1, cast(pmod(`{column}`, {self.size}L) % 32 AS int))").alias("b"))
        # size / 32 rows of 8 bytes at most; in Arrow, as the driver would hold hundreds of bytes for each as an object
        found = words.groupBy("w").agg(F.bit_or("b").alias("bits")).toArrow()
        self.words = np.zeros(self.size // 32 + 1, dtype=np.uint32)
        for batch in found.to_batches():
            w, bits = (c.to_numpy() for c in batch.columns)
            self.words[w] = bits.view(np.uint32)

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        at = numbers.astype(np.int64) % self.size
        return (self.words[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)


class Recent(dict):
    """A bounded memo: self[key] is find(key) unless known. Two generations, so that frequent keys stay; long keys are not kept."""

    def __init__(self, find: Callable, size: int):
        self.find, self.size, self.old = find, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        if not isinstance(key, (str, bytes)) or len(key) <= KEPT:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
