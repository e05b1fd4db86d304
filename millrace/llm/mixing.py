"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the budget by its weight, but at most `max_epochs` times its
own size. What capped sources leave goes to the others by weight, again and again until no
source is above its cap. Sources are capped in order of cap / weight, so one sort of the table of sources
with running sums finds the level at which that ends; one number goes to the driver.

A source whose target is k + f times its size is taken k times whole, and once more up to
the fraction f. For that its documents are put into a seeded random order, and the first
ones are taken until f is reached; the document on the boundary is taken in part. The order
is not sorted: sizes are summed by cells of the hash, and only the documents in
each source's boundary cell are ranked.

Defined results: a null text has size 0; null is a source of its own, last in order. A
source without words has target 0. Rows that repeat an id are each a document; their order
in a cell follows their size. An empty table gives none. Other columns are not looked at and, in the mix,
come back as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written

#: Hexadecimal digits of a hash that give the cell, and those that give the order in it.
CELL_DIGITS, ORDER_DIGITS = 4, 12

#: Cells that are summed as one block first, so no window holds more than 256 rows of a source.
BLOCK = 256


def word_count(text: Column) -> Column:
    """Number of matches of [^\\x20\\x09-\\x0D]+; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weighted(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Weights repeat along the sources in order of code points, null last. Ranked by range, not in one task."""
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ordered = written(ordered, "ordered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = ordered.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    place = F.col("before") + F.row_number().over(inside) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    return ordered.join(offsets, "part").select("source", "source_size", weight.alias("weight"))


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """source, source_size, target. sources: source, source_size, weight."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    open_at = cap / F.col("weight")  # the level at which a source is full
    before = Window.orderBy("full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each source
    every = Window.orderBy("full").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held, used = (F.coalesce(F.sum(x).over(before), F.lit(0.0)) for x in (cap, F.col("weight")))
    level = (F.lit(float(budget)) - held) / (F.sum("weight").over(every) - used)
    ranked = sources.withColumn("full", open_at).withColumn("level", level)
    # the highest level that the first source still open can take; if there is none, all are full
    found = ranked.agg(F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).alias("level"), F.max("full").alias("top")).first()
    reached = found["level"] if found["level"] is not None else found["top"]
    return sources.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(float(reached or 0.0))).alias("target"))


def _plan(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """A row for each source: its target, whole repetitions, boundary cell, and the words to take from that. sizes: source, cell, size."""
    cells = written(sizes.groupBy("source", "cell").agg(F.sum("size").alias("words")), "cells")  # 65,536 a source at most
    totals = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    total = cells.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    targets = water_fill(_weighted(totals, weights), share * total, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = written(targets.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")), "targets")
    rest = targets.select(F.col("source").alias("of"), "rest")
    block = F.floor(F.col("cell") / BLOCK).cast("int")
    blocks = cells.withColumn("block", block).groupBy("source", "block").agg(F.sum("words").alias("words"))
    blocks = _boundary(blocks, rest, "block").select("of", F.col("at").alias("block_of"), "rest")
    inside = cells.join(blocks, F.col("source").eqNullSafe(F.col("of")) & (block == F.col("block_of"))).select("source", "cell", "words")
    edge = _boundary(inside, blocks.select("of", "rest"), "cell").select("of", F.col("at").alias("edge"), F.col("rest").alias("left"))
    plan = targets.join(edge, F.col("source").eqNullSafe(F.col("of")), "left")
    return written(plan.select(F.col("source").alias("of"), "source_size", "target", "whole", F.coalesce("edge", F.lit(-1)).alias("edge"), F.coalesce("left", F.lit(0)).alias("left")), "plan")


def _boundary(parts: DataFrame, rest: DataFrame, place: str) -> DataFrame:
    """of, at, rest: where each source's parts, in order of place, reach its rest, and what is then left of it. parts: source, place, words."""
    upto = Window.partitionBy("source").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    spent = parts.withColumn("spent", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    found = spent.join(rest, F.col("source").eqNullSafe(F.col("of"))).where("spent < rest and spent + words >= rest")
    return found.select("of", F.col(place).alias("at"), (F.col("rest") - F.col("spent")).alias("rest"))


#: Most sources whose plan is broadcast; the plan of more is joined by shuffles, where Spark splits large sources.
BROADCAST_SOURCES = 100_000


def _drawn(docs: DataFrame, seed: int, text: str, key: str, source: str) -> DataFrame:
    """Each row of docs as a struct `doc`, its id, source and size, and a cell and an order in it that seed and id decide."""
    column = lambda name: F.col(f"`{name}`")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column(key).cast("string"), F.lit(""))))
    number = lambda at, n: F.conv(F.substring(draw, at, n), 16, 10).cast("long")
    return docs.select(
        F.struct(*map(column, docs.columns)).alias("doc"), column(key).alias("id"), column(source).alias("source"),
        word_count(column(text)).alias("size"), number(1, CELL_DIGITS).alias("cell"), number(1 + CELL_DIGITS, ORDER_DIGITS).alias("order"),
    )


def _taken(drawn: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """drawn with the words taken of each row."""
    plan = _plan(drawn.select("source", "cell", "size"), weights, share, max_epochs)
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    found = drawn.join(plan, F.col("source").eqNullSafe(F.col("of")))
    base = F.col("whole") * F.col("size")
    away = found.where("cell != edge").withColumn("taken", base + F.when(F.col("cell") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    inside = Window.partitionBy("source").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("left") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    near = found.where("cell = edge").withColumn("taken", base + F.greatest(F.lit(0), F.least("size", left)))
    return away.unionByName(near)


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted). Reruns give the same."""
    drawn = written(_drawn(docs, seed, text, key, source).drop("doc"), "sizes")
    return _taken(drawn, weights, share, max_epochs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its nth word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole repetition of a document, and one cut to the words taken for a fraction."""
    found = _taken(_drawn(docs, seed, text, key, source), weights, share, max_epochs).where("size > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    repeated = found.where(whole > 0).select("doc", F.explode(F.sequence(F.lit(1), whole))).select("doc.*")
    column = {c: F.col(f"doc.`{c}`") for c in docs.columns}
    column[text] = first_words(column[text], F.col("taken") % F.col("size")).cast(docs.schema[text].dataType)
    if "n_chars" in docs.columns:
        column["n_chars"] = F.length(column[text]).cast(docs.schema["n_chars"].dataType)
    part = found.where(F.col("taken") % F.col("size") > 0).select(*(x.alias(c) for c, x in column.items()))
    return repeated.unionByName(part)
