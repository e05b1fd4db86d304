"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import dropped, in_arrow, join_groups, written

#: Links that a task holds at a time in the local step.
LOCAL = 500_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task as (node, least node it is joined to), a bounded number of links at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], type=pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > LOCAL:
            yield flush()
    if parent:
        yield flush()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of these. links: u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = join_groups(links, least, ["u"], "n").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
    return joined.select("x.u", F.col("x.m").alias("v")).where("u != v").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the smallest of its neighbourhood."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    joined = join_groups(both.where("v > u"), least, ["u"], "n")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of each id that has a link and isn't its component's smallest. links: a, b.

    Union-find inside tasks first, then large and small stars between them until every
    node points at a root: the depth halves each time.
    """
    ordered = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    now = written(in_arrow(ordered, _union_find, "u long, v long").distinct(), "links")
    while True:
        several = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        chained = now.select(F.col("v").alias("u")).distinct().join(now.select("u"), "u", "left_semi")
        if several.isEmpty() and chained.isEmpty():
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        large = written(_large_star(now), "links")
        last, now = now, written(_small_star(large), "links")
        dropped(last, large)
