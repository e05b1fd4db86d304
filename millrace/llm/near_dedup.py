"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A text is lower-cased in A-Z, its words are runs of characters other than blanks, and its set
has the distinct shingles of k words, as 64-bit hashes; a shorter text is one
shingle. Two documents are linked if the Jaccard similarity of their sets is high enough.

1. Signatures. In round j every element draws a number in [j, j + 1) and swaps entry j of its
   own permutation with a random later one; the number goes to the slot that is now at j. Slots keep
   their minimum. Once no slot is above j + 1 later rounds can't change any, so
   large sets stop after one round. Documents of equal sets are one class from here on.
2. Banding. Classes that agree in all rows of a band share a bucket.
3. Verification. Each member of a bucket is compared with the bucket's hub, the member that
   shares most, on full sets. That is one pair for each member, never all pairs. Links are grouped
   by union-find.
4. The rest. In a bucket whose members are in several components, members outside its largest one
   are compared, in blocks, with all others of different components. A block holds its members'
   whole sets, bounded in rows and elements, and counts all common shingles in one product of
   matrices, so links are exact; of those to one component a member needs the best only. Members of one
   component need no further pair, so no link between components is lost, and a group's pairs never
   become rows. Of buckets with the same members one is compared. A member's set travels once to each block of the others: where a bucket holds many that
   are close and yet not linked, what is shuffled grows with the square of their number, by blocks.

A linked pair shares no bucket with probability (1 - s ** rows) ** bands, at s = 0.8 and the defaults
6e-5.

Defined results: null, empty and blank texts have an empty set and are linked with
nothing. Equal sets are linked. Rows without an id are linked with nothing, and stay. Rows
repeated under one id are one document in the groups, each with its row; texts that
differ under one id join their groups. An empty table gives an empty
result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Bitmap, Recent, dropped, in_arrow, join_groups, map_batches, map_slices, without, written
from millrace.llm.components import components

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    def __init__(self, words: int, memo: int = 100_000):
        self.words = words
        self.hashes = Recent(xxhash.xxh3_64_intdigest, memo)
        self.factors = _mix(np.arange(1, words + 1, dtype=np.uint64) * _ODD[0]) | np.uint64(1)

    def of(self, text: str | None) -> np.ndarray:
        """The text's set, sorted."""
        words = (text or "").encode().lower().split()
        h = np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(self.words, len(h))
        if not n:
            return h
        total = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            total += _mix(h[k : len(h) - n + 1 + k]) * self.factors[k]
        return np.unique(_mix(total))


def super_minhash(elements: np.ndarray, slots: int) -> np.ndarray:
    """The signature: in each slot the round in the upper and the draw in the lower 32 bits."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    out = np.full(slots, np.iinfo(np.uint64).max, dtype=np.uint64)
    order = None
    rows = np.arange(len(elements))
    rounds = np.arange(1, slots + 1, dtype=np.uint64) * _ODD[1]
    for j in range(slots):
        draw = _mix(elements + rounds[j])
        other = (((draw & low) * np.uint64(slots - j)) >> half).astype(np.int64) + j
        if order is None:
            place = other  # nothing is swapped yet
        else:
            place = order[rows, other]
            order[rows, other] = order[rows, j]
        np.minimum.at(out, place, np.uint64(j) << half | draw >> half)
        if out.max() < np.uint64(j + 1) << half:
            break
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
            order[rows, other] = 0
    return out


@dataclass(frozen=True)
class Near:
    """words: of a shingle; percent: least similarity; bands of rows slots each."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 6

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def signatures(rows: DataFrame, how: Near) -> DataFrame:
    """doc_id, n_shingles, set_key (null if empty), buckets. rows: doc_id, text."""

    def make():
        shingles = Shingles(how.words)
        band = _mix(np.arange(1, how.bands + 1, dtype=np.uint64) * _ODD[2])
        factors = _mix(np.arange(1, how.rows + 1, dtype=np.uint64) * _ODD[3]) | np.uint64(1)

        def step(c: dict) -> dict:
            n, keys, buckets = [], [], []
            for text in c["text"]:
                found = shingles.of(text)
                n.append(len(found))
                if not len(found):
                    keys.append(None), buckets.append(None)
                    continue
                s = _mix(super_minhash(found, how.slots))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                buckets.append(_mix((s.reshape(how.bands, how.rows) * factors).sum(axis=1, dtype=np.uint64) ^ band).view(np.int64))
            return {"doc_id": c["doc_id"], "n_shingles": n, "set_key": keys, "buckets": buckets}

        return step

    return map_batches(rows, make, "doc_id long, n_shingles long, set_key binary, buckets array<long>")


def _sets(rows: DataFrame, ids: Bitmap, how: Near) -> DataFrame:
    """id and set of the documents that may be among ids."""

    def make():
        shingles = Shingles(how.words)

        def step(part: pa.RecordBatch) -> dict:
            known = part.filter(part.column("doc_id").is_valid())
            mine = known.filter(pa.array(ids.holds(known.column("doc_id").to_numpy()), pa.bool_()))
            sets = [shingles.of(t) for t in mine.column("text").to_pylist()]
            bounds = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            return {"id": mine.column("doc_id"), "elements": pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64)))}

        return step

    return map_slices(rows, make, "id long, elements array<long>")


def verified(pairs: DataFrame, sets: DataFrame, how: Near) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. pairs: a written table.

    A document b may have pairs with a large share of all others: its set goes to each block of about 256 of them.
    """
    degree = pairs.groupBy("b").agg(F.count("*").alias("n"))
    blocked = join_groups(pairs, degree, ["b"], "n").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / 256)).alias("block"))
    left = blocked.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a")
    hubs = blocked.select("b", "block").distinct().join(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b")
    common = F.size(F.array_intersect("ea", "eb"))
    union = F.size("ea") + F.size("eb") - common
    return left.join(hubs, ["b", "block"]).where(100 * common >= how.percent * union).select("a", "b").distinct()


#: Rows of a bucket that a block holds, of those outside its largest component and of all, and elements of their sets.
QUERY_BLOCK, BLOCK, ELEMENTS = 256, 512, 1 << 19


def _common(sets: list[np.ndarray], query: np.ndarray) -> np.ndarray:
    """Numbers of common elements of each query's set with each other one's."""
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    times = np.diff(np.append(first, len(values)))
    column = np.repeat(np.cumsum(times > 1) - 1, times)  # only elements of several sets have one
    kept = np.repeat(times > 1, times)
    column, rows = column[kept], rows[kept]
    out = np.zeros((int(query.sum()), int((~query).sum())), dtype=np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        some = slice(*np.searchsorted(column, [at, at + width]))
        held = np.zeros((len(sets), width), dtype=np.float32)
        held[rows[some], column[some] - at] = 1
        out += held[query] @ held[~query].T
    return out


def _block_links(how: Near):
    """For rows sorted by (bucket, i, j): links between different components, the best of each query and component."""

    def links(ids: np.ndarray, comps: np.ndarray, query: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        if query.all() or not query.any():
            return []
        sizes = np.array([len(s) for s in sets], dtype=np.float32)
        q, t = np.flatnonzero(query), np.flatnonzero(~query)
        common = _common(sets, query)
        union = sizes[q][:, None] + sizes[t] - common
        fit = (100 * common >= how.percent * union) & (comps[q][:, None] != comps[t])
        out = []
        for k in np.flatnonzero(fit.any(axis=1)):
            near = np.flatnonzero(fit[k])
            near = near[np.argsort(-common[k][near] / union[k][near], kind="stable")]
            for x in {comps[x]: x for x in t[near][::-1]}.values():
                out.append((max(ids[x], ids[q[k]]), min(ids[x], ids[q[k]])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            found = links(np.array([r[3] for r in held]), np.array([r[4] for r in held]), np.array([r[5] for r in held]), [r[6] for r in held])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in found], type=pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            *columns, lists = batch.columns
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k, row in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                if held and held[0][:3] != row[:3]:
                    yield close()
                held.append((*row, values[bounds[k] : bounds[k + 1]].copy()))
        if held:
            yield close()

    return run


def _mixed(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, one of those with the same members: bucket, id, c, top (is c the largest?), and numbers of blocks."""
    labelled = shared.join(comps, "id", "left").select("bucket", "id", "elements", F.coalesce("component", "id").alias("c"))
    labelled = written(labelled, "labelled")
    # members as two sums of 64-bit hashes: buckets of the same members have the same pairs, and one of them is enough
    member = lambda k: F.sum(F.xxhash64("id", "elements", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}")
    sizes = labelled.groupBy("bucket", "c").agg(F.count("*").alias("n"), F.sum("elements").alias("m"), member(0), member(1))
    buckets = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("m").alias("m"), F.max(F.struct("n", "c", "m")).alias("top"), F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
    buckets = buckets.where("parts > 1").groupBy("n", "m", "s0", "s1").agg(F.min("bucket").alias("bucket"), F.min("top").alias("top"))
    ni = F.greatest(F.ceil((F.col("n") - F.col("top.n")) / QUERY_BLOCK), F.ceil((F.col("m") - F.col("top.m")) / ELEMENTS))
    nj = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("m") / (2 * ELEMENTS)))
    buckets = buckets.select("bucket", "n", F.col("top.c").alias("top"), ni.cast("int").alias("ni"), nj.cast("int").alias("nj"))
    mixed = written(join_groups(labelled, buckets, ["bucket"], "n", "inner").drop("elements").withColumn("top", F.col("c") == F.col("top")), "mixed")
    dropped(labelled)
    return mixed


def _blocks(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows dealt into blocks: each block of those outside the largest component meets each block of all."""
    members = mixed.join(sets, "id")
    draw = F.xxhash64("id", F.lit("block"))
    every = members.select("*", F.lit(False).alias("query"), F.pmod(draw, F.col("nj")).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"))
    outside = members.where("not top").select("*", F.lit(True).alias("query"), F.pmod(draw, F.col("ni")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"))
    names = ("bucket", "i", "j", "id", "c", "query", "elements")
    return every.select(*names).unionByName(outside.select(*names)).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def links_of(rows: DataFrame, classes: DataFrame, how: Near) -> DataFrame:
    """Links that join all classes which similarity joins. classes: doc_id, n_shingles, buckets, one for each set."""
    members = classes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("elements"), F.explode("buckets").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(join_groups(members, buckets, ["bucket"], "n", "inner"), "shared")
    mass = shared.groupBy("id").agg(F.sum("n").alias("mass"))
    best = shared.join(mass, "id").groupBy("bucket").agg(F.max(F.struct("mass", F.expr("~id").alias("less"), "id")).alias("top"), F.count("*").alias("n"))
    hubs = join_groups(shared.select("bucket", "id"), best.select("bucket", "n", F.col("top.id").alias("hub")), ["bucket"], "n", "inner")
    tried = written(hubs.where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "tried")
    sets = written(_sets(rows, Bitmap(shared.select("id").distinct(), "id"), how), "sets")
    links = written(verified(tried, sets, how), "found")
    dropped(tried)
    mixed = _mixed(shared, written(components(links), "components"))
    more = written(in_arrow(_blocks(mixed, sets), _block_links(how), "a long, b long").distinct(), "more")
    dropped(shared, sets, mixed)
    return links.unionByName(more)


def near_groups(docs: DataFrame, how: Near = Near(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable), kept (is it the document's own?)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(signatures(rows, how), "signatures")
    sets = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    sets = written(sets, "classes")
    classes = signed.join(sets.select(F.col("first").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"])
    classes = written(classes, "representatives")
    comps = components(links_of(rows, classes, how))
    labels = sets.join(comps, sets["first"] == comps["id"], "left").select("set_key", "n", F.coalesce("component", "first").alias("component"))
    labels = written(labels, "labels")
    dropped(sets, classes)
    found = join_groups(signed.select("doc_id", "n_shingles", "set_key"), labels, ["set_key"], "n")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, how: Near = Near(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, one document of each group, with all their columns."""
    gone = near_groups(docs, how, text, key).where("not kept").select("doc_id").distinct()
    return without(docs, written(gone, "gone"), key)
