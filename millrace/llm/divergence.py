"""How sources of a language differ in their words, by run-length columns.

Each group (language and source) has a column over its language's kept terms: the counts of
the terms there, most of them 0. Steps:

1. Tasks count terms by group and documents by term, and sum up before they send. The terms of
   at least `least` documents of a language are its vocabulary.
2. The vocabulary is put in an order in which equal counts stand together: terms with the same
   counts in all groups become one cluster with its number of terms, and clusters are sorted by
   their counts, source by source. The order is dealt into tiles, ranges of it.
3. A tile's task run-length encodes each group's column. For a pair of groups the bounds of both
   columns' runs are merged; in each piece between two bounds both have one probability, so f is
   found once and multiplied by the piece's length. Sums of tiles are added.

All numbers are whole: p = 1 + floor(scale * (count + 2) / (N + 2 V)), f = floor((p - q)^2 / (p + q)).

Part `pair` has the sum of f over the vocabulary for each other source of the language; part `term` has
f against the language as a whole for the terms that a group has and uses more often, the first `top` of them.

Defined results: null text, language and source count as empty. Groups without terms take part
with counts of 0; a language without a vocabulary gives pairs of value 0. Rows that repeat an id
are each a document. An empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import dropped, in_arrow, slices, written
from millrace.llm.words import classes, merged_tables, split, sums_by

SCALE = 1_000_000_000

#: Terms are runs of A-Z, a-z and all characters from U+0080.
LETTERS = classes("".join(chr(b) for b in range(128) if not chr(b).isalpha()))

#: Texts that are split at a time, and counts that a task sums up before it sends them.
TEXTS, COUNTED = 2048, 1_000_000

#: Counts of a tile, and groups that are broadcast at most; more are joined by a shuffle.
ENTRIES, BROADCAST_GROUPS = 1 << 19, 100_000

_COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(rows: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents of the group that have it), not yet summed. rows: lang, source, text.

    Each group has rows of an empty term, so that it is there even without terms.
    """

    def table_of(part: pa.RecordBatch) -> pa.Table:
        words = split(part.column("text"), LETTERS)
        lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        n = len(words.distinct) + 1  # place 0 is the empty term
        each, times = np.unique(words.text * n + words.place + 1, return_counts=True)
        keys, sums, docs = sums_by(group[each // n] * n + each % n, times, np.ones(len(each), dtype=np.int64))
        known = np.unique(group)
        keys, sums, docs = np.append(keys, known * n), np.append(sums, 0 * known), np.append(docs, 0 * known)
        terms = pa.concat_arrays([pa.array([""]), words.distinct.cast(pa.string())])
        at = keys // n
        columns = (lang.dictionary.take(pa.array(at // len(source.dictionary))), source.dictionary.take(pa.array(at % len(source.dictionary))), terms.take(pa.array(keys % n)), sums, docs)
        return pa.table(dict(zip(("lang", "source", "term", "n", "docs"), columns, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for part in slices(batch, TEXTS):
                found.append(table_of(part))
                size += found[-1].num_rows
                if size > COUNTED:
                    yield from merged_tables(found, ["lang", "source", "term"])
                    found, size = [], 0
        yield from merged_tables(found, ["lang", "source", "term"])

    return in_arrow(rows, run, _COUNTS)


def _share(n: str, total: str, terms: str) -> Column:
    """p of a count, in decimals that hold every product."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + 2 as decimal(20, 0))) div cast({total} + 2 * {terms} as decimal(20, 0))")


def vocabulary(docs: DataFrame, least: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Tables of terms and of groups.

    terms: lang, term, total, entries (source and n). groups: lang, source, place (from 0), size, lang_size, terms.
    """
    column = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(""))
    rows = docs.select(column(lang).alias("lang"), column(source).alias("source"), column(text).alias("text"))
    # dealt by term once: sums by source and then by term stay where they are
    counted = term_counts(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("entries"))
    terms = written(found.where((F.col("docs") >= least) | (F.col("term") == "")), "terms")
    sizes = terms.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("size"))
    langs = terms.groupBy("lang").agg(F.sum("total").alias("lang_size"), F.count_if(F.col("term") != "").alias("terms"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row for each source
    return terms, written(sizes.join(langs, "lang").withColumn("place", place), "groups")


def _entries(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each term and group that has it, with what is known of the group."""
    entries = terms.where("term <> ''").select("lang", "term", "total", F.explode("entries").alias("e")).select("lang", "term", "total", "e.source", "e.n")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    return entries.join(groups, ["lang", "source"])


def runs_of(at: np.ndarray, value: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of the runs of a column of `length` that is 0 but for `value` at the rising places `at`."""
    start = np.zeros(2 * len(at) + 1, dtype=np.int64)
    found = np.zeros(len(start), dtype=np.int64)
    start[1::2], start[2::2], found[1::2] = at, at + 1, value
    last = np.append(start[1:] != start[:-1], True)  # of those at one place
    start, found = start[last], found[last]
    new = np.append(True, found[1:] != found[:-1]) & (start < length)
    return start[new], found[new]


def divergence(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """Sum of f over two columns of probabilities, given as starts and values of runs."""
    start = np.union1d(a[0], b[0])
    p, q = (x[1][np.searchsorted(x[0], start, side="right") - 1] for x in (a, b))
    return int((np.diff(start, append=length) * ((p - q) ** 2 // (p + q))).sum())


class Tile:
    """Groups of a language, and clusters of terms in order of their counts."""

    def __init__(self, lang: str):
        self.lang, self.groups, self.terms = lang, [], 0
        self.clusters: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rows: pa.RecordBatch) -> None:
        if rows.column("cluster")[0].as_py():
            places, counts = rows.column("places"), rows.column("counts")
            self.clusters.append((np.diff(places.offsets.to_numpy()), places.flatten().to_numpy(), counts.flatten().to_numpy(), rows.column("terms").to_numpy()))
        else:
            self.groups += zip(rows.column("source").to_pylist(), (x[0] for x in rows.column("counts").to_pylist()), strict=True)
            self.terms = rows.column("terms")[0].as_py()

    def columns(self) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """Each group's column of probabilities as starts and values of runs, and the columns' length."""
        width, place, count, terms = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*self.clusters, strict=True) if self.clusters else [()] * 4))
        ends = np.append(0, np.cumsum(terms))  # clusters of many terms are long
        cluster = np.repeat(np.arange(len(width)), width)
        order = np.lexsort((cluster, place))
        bounds = np.searchsorted(place[order], np.arange(len(self.groups) + 1))
        out = []
        for k, (_, size) in enumerate(self.groups):
            mine = order[bounds[k] : bounds[k + 1]]
            start, value = runs_of(cluster[mine], count[mine], len(width))
            counts, at = np.unique(value, return_inverse=True)
            p = np.array([1 + SCALE * (c + 2) // (size + 2 * self.terms) for c in counts.tolist()], dtype=np.int64)
            out.append((ends[start], p[at]))
        return out, int(ends[-1])

    def pairs(self) -> Iterator[pa.RecordBatch]:
        """Each two groups' sum over the tile."""
        names = [s for s, _ in self.groups]
        columns, length = self.columns() if self.clusters else ([], 0)
        for k, a in enumerate(names[:-1]):
            sums = [divergence(columns[k], b, length) for b in columns[k + 1 :]] if length else [0] * (len(names) - k - 1)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in (([self.lang] * len(sums), pa.string()), ([a] * len(sums), pa.string()), (names[k + 1 :], pa.string()), (sums, pa.int64()))], names=["lang", "source", "item", "value"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by language and tile, groups before clusters."""
    now, at = None, None
    for batch in batches:
        lang, tile, kind = batch.column("lang").dictionary_encode().indices.to_numpy(), batch.column("tile").to_numpy(), batch.column("cluster").to_numpy(zero_copy_only=False)
        new = np.append(True, (lang[1:] != lang[:-1]) | (tile[1:] != tile[:-1]) | (kind[1:] != kind[:-1])) if len(lang) else np.zeros(0, dtype=bool)
        bounds = np.append(np.flatnonzero(new), len(lang))
        for a, b in zip(bounds, bounds[1:], strict=False):
            key = batch.column("lang")[a].as_py(), int(tile[a])
            if key != at:
                if now:
                    yield from now.pairs()
                now, at = Tile(key[0]), key
            now.add(batch.slice(a, b - a))
    if now:
        yield from now.pairs()


def pair_values(terms: DataFrame, groups: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """lang, source, item, value: each two sources of a language, in both directions."""
    placed = _entries(terms, groups).select("lang", "term", "place", "n")
    counts = placed.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("counts"))
    clusters = written(counts.groupBy("lang", "counts").agg(F.count("*").alias("terms")), "clusters")
    tiles = 1 + clusters.agg(F.coalesce(F.sum(F.size("counts")), F.lit(0))).first()[0] // entries
    # the first counts give the range, so what is sampled to find the ranges stays small; all of them sort the tile
    ranged = clusters.repartitionByRange(tiles, "lang", F.slice("counts", 1, 3), F.xxhash64("counts")).withColumn("tile", F.spark_partition_id())
    ranged = written(ranged, "tiles")
    dropped(clusters)
    of = F.transform("counts", lambda x: x["place"]), F.transform("counts", lambda x: x["n"])
    rows = ranged.select("lang", "tile", F.lit(True).alias("cluster"), F.lit(None).cast("string").alias("source"), of[0].alias("places"), of[1].alias("counts"), "terms", F.col("counts").alias("order"))
    every = groups.join(ranged.select("lang", "tile").distinct(), "lang", "left").select(
        "lang", F.coalesce("tile", F.lit(-1)).alias("tile"), F.lit(False).alias("cluster"), "source", F.array("place").alias("places"), F.array("size").alias("counts"), "terms", F.array(F.struct("place", F.lit(0).cast("long").alias("n"))).alias("order"),
    )
    dealt = every.unionByName(rows).repartition("lang", "tile").sortWithinPartitions("lang", "tile", "cluster", "order").drop("order")
    sums = in_arrow(dealt, _pairs, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("item").alias("b")), F.struct(F.col("item").alias("a"), F.col("source").alias("b"))))
    return sums.select("lang", both.alias("x"), "value").select("lang", F.col("x.a").alias("source"), F.col("x.b").alias("item"), "value")


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source", *, entries: int = ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank. entries: counts of a tile, about; the result doesn't depend on it."""
    terms, groups = vocabulary(docs, least, text, lang, source)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(terms, groups, entries).withColumn("rank", rank)
    p, q = F.col("p"), F.col("q")
    used = _entries(terms, groups).where("n > 0").select("lang", "source", F.col("term").alias("item"), _share("n", "size", "terms").alias("p"), _share("total", "lang_size", "terms").alias("q"))
    used = used.where(p > q).select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value")).withColumn("rank", rank).where(F.col("rank") <= top)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(used.withColumn("part", F.lit("term")).select(*columns))
