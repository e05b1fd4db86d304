"""Collocations: phrases of two and three words that stand together more often than their parts do apart.

1. Tasks count words by language. Words that occur `least` times may be part of a phrase; the most
   frequent of them, HELD at most, get ids by falling frequency, and tasks hold these. Of the others tasks
   hold a bitmap of bounded size that may let a rare word through, and know a word by a 62-bit hash under
   which, as is checked on the table of all words, no two words that occur often enough together are the same.
2. Tasks count pairs of neighbours. Ids go into tiles of SIDE x SIDE: frequent words meet in the tiles near
   the origin, which are counted by direct address (numpy's bincount) once they get enough pairs; what falls
   into sparse tiles is counted as sorted coordinates. Counts of tasks are added by a shuffle.
3. Pairs that occur `least` times are ranked again by frequency and get ids as words did. A phrase of three words
   is a pair of such an id and a word, if its last two words are a frequent pair, too; these are counted in the same way.

Scores are whole numbers from decimals that hold every product. A phrase inside a longer one that has at least `share`
percent of its occurrences goes. Each language's first `top` phrases are returned.

Defined results: null text is empty, null language counts as `und`. Rows that repeat an id are each a document. Phrases
don't cross the marks .,;:!? and ends of lines. A language whose phrases are all too rare gives no row; an empty table gives none.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import Bitmap, dropped, give_back, in_arrow, slices, written
from millrace.llm.words import classes, heaviest, merged_tables, split, sums_by

#: Words are separated by blanks and tabs, pieces by these marks and ends of lines.
PIECES = classes(" \t", ".,;:!?\n\x0b\x0c\r")

#: Words and pairs that tasks hold at most; bits of their ids.
HELD_WORDS, HELD_PAIRS = 1 << 18, 1 << 20
WORD_BITS = 18

#: Side of a tile, tiles from the origin in each direction that may be counted by direct address, and the pairs that make it worth while.
SIDE, NEAR, WORTH = 512, 6, 1 << 15

#: Texts that are split at a time, counts of words that a task sums up, pairs it gathers before it counts them, and distinct pairs it holds.
TEXTS, COUNTED, GATHERED, DISTINCT = 2048, 1_000_000, 1 << 20, 1 << 21

#: Hashes have 62 bits, so codes of words without an id are negative numbers under -1.
_LOW = (1 << 62) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hash(lang: str, word: bytes, seed: int) -> int:
    """62 bits; what hash_column() gives in Spark."""
    first = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), seed=42)
    return xxhash.xxh64_intdigest(word, seed=xxhash.xxh64_intdigest(lang.encode(), seed=first)) & _LOW


def hash_column(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "lang", "word").bitwiseAND(_LOW)


def pair_hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """62 bits of each pair of codes."""
    h = x.view(np.uint64) * _A + y.view(np.uint64)
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return (h & np.uint64(_LOW)).view(np.int64)


class Tiles:
    """Counts of pairs of ids. What is held is bounded: NEAR x NEAR tiles, GATHERED pairs and DISTINCT counts; more are given out."""

    def __init__(self, gathered: int = GATHERED, distinct: int = DISTINCT, worth: int = WORTH):
        self.gathered, self.distinct, self.worth = gathered, distinct, worth
        self.dense: dict[int, np.ndarray] = {}
        self.new: list[np.ndarray] = []
        self.sparse: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.held = 0

    def add(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Counts the pairs; yields (left, right, counts) where there are too many to hold."""
        self.new.append(left << 32 | right)
        self.waiting += len(left)
        if self.waiting >= self.gathered:
            self._count()
        if self.held >= self.distinct:
            self._merge()
            if self.held >= self.distinct // 2:
                yield from self._give()

    def _count(self) -> None:
        keys = np.concatenate([np.zeros(0, dtype=np.int64), *self.new])
        self.new, self.waiting = [], 0
        left, right = keys >> 32, keys & 0xFFFFFFFF
        near = (left < NEAR * SIDE) & (right < NEAR * SIDE)
        tile = np.where(near, left // SIDE * NEAR + right // SIDE, NEAR * NEAR)
        apart = np.ones(len(keys), dtype=bool)
        for t in np.flatnonzero(np.bincount(tile, minlength=NEAR * NEAR + 1)[:-1] >= self.worth):
            mine = tile == t
            found = np.bincount(left[mine] % SIDE * SIDE + right[mine] % SIDE, minlength=SIDE * SIDE)
            self.dense[t] = self.dense[t] + found if t in self.dense else found
            apart &= ~mine
        keys, counts = np.unique(keys[apart], return_counts=True)  # sparse tiles: coordinates in order
        self.sparse.append((keys, counts))
        self.held += len(keys)

    def _merge(self) -> None:
        if len(self.sparse) > 1:
            self.sparse = [sums_by(*(np.concatenate(x) for x in zip(*self.sparse, strict=True)))]
        self.held = sum(len(k) for k, _ in self.sparse)

    def _give(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for keys, counts in self.sparse:
            yield keys >> 32, keys & 0xFFFFFFFF, counts
        self.sparse, self.held = [], 0

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self._count()
        self._merge()
        yield from self._give()
        for t, counts in self.dense.items():
            at = np.flatnonzero(counts)
            yield t // NEAR * SIDE + at // SIDE, t % NEAR * SIDE + at % SIDE, counts[at]
        self.dense = {}


class Apart:
    """Counts of rows of codes of which some are no ids, as sorted coordinates."""

    def __init__(self, distinct: int = DISTINCT // 4):
        self.distinct, self.found, self.held = distinct, [], 0

    def add(self, *codes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        if len(codes[0]):
            self.found.append((*codes, np.ones(len(codes[0]), dtype=np.int64)))
            self.held += len(codes[0])
        if self.held >= self.distinct:
            yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, ...]]:
        if not self.found:
            return
        *codes, n = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found, self.held = [], 0
        order = np.lexsort(codes)
        codes, n = [c[order] for c in codes], n[order]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in codes], axis=0))
        at = np.flatnonzero(new)
        yield *(c[at] for c in codes), np.add.reduceat(n, at)


@dataclass
class Vocabulary:
    """What tasks know of words: hashes of the held ones in order with their ids, and a bitmap of hashes of the others that are frequent."""

    seed: int
    hashes: np.ndarray
    ids: np.ndarray
    others: Bitmap | None

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashes, -1 for those that are not held."""
        out = np.full(len(h), -1, dtype=np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            out[hit] = self.ids[at[hit]]
        return out

    def codes(self, langs: list[str], lang_of: np.ndarray, words: pa.Array, word_of: np.ndarray) -> np.ndarray:
        """A code for each (language, word): an id, a negative number, or -1 for a word that is in no phrase."""
        first = [xxhash.xxh64_intdigest(x.encode(), seed=xxhash.xxh64_intdigest(self.seed.to_bytes(4, "little"), seed=42)) for x in langs]
        known = words.to_pylist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(known[w], seed=first[g]) & _LOW for g, w in zip(lang_of.tolist(), word_of.tolist(), strict=True)), dtype=np.int64, count=len(word_of))
        out = self.find(h)
        if self.others is not None:
            away = np.flatnonzero(out < 0)
            away = away[self.others.holds(h[away])]
            out[away] = -2 - h[away]
        return out


@dataclass
class Pairs:
    """What tasks know of pairs: keys of the held ones in order with their ids and words, and a bitmap of the others that are frequent."""

    keys: np.ndarray
    ids: np.ndarray
    left: np.ndarray  # by id
    right: np.ndarray
    others: Bitmap | None

    def codes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A pair's id, -1 for a pair that is rare, or -2 for one that may be frequent but has no id."""
        out = np.full(len(x), -1, dtype=np.int64)
        if len(self.keys):
            both = np.flatnonzero((x >= 0) & (y >= 0))
            key = x[both] << WORD_BITS | y[both]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[both[hit]] = self.ids[at[hit]]
        if self.others is not None:
            away = np.flatnonzero((out == -1) & (x != -1) & (y != -1))
            out[away[self.others.holds(pair_hash(x[away], y[away]))]] = -2
        return out


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))


def _by_lang(part: pa.RecordBatch):
    """Words of a slice, its languages, and each distinct (language, word) with its number at each word."""
    words = split(part.column("text"), PIECES)
    langs = part.column("lang").dictionary_encode()
    n = max(1, len(words.distinct))
    keys = langs.indices.to_numpy().astype(np.int64)[words.text] * n + words.place
    known, at = np.unique(keys, return_inverse=True)
    return words, langs.dictionary, known // n, known % n, at


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, n. rows: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for part in slices(batch, TEXTS):
                words, langs, lang, word, at = _by_lang(part)
                table = {"lang": langs.take(pa.array(lang)), "word": words.distinct.take(pa.array(word)).cast(pa.string()), "n": np.bincount(at, minlength=len(word))}
                found.append(pa.table(table))
                size += len(word)
                if size > COUNTED:
                    yield from merged_tables(found, ["lang", "word"])
                    found, size = [], 0
        yield from merged_tables(found, ["lang", "word"])

    return in_arrow(rows, run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _seed(words: DataFrame, least: int) -> int:
    """The first seed under which words that share a hash are too rare even together."""
    seed = 0
    while not words.groupBy(hash_column(seed)).agg(F.count("*").alias("words"), F.sum("n").alias("n")).where((F.col("words") > 1) & (F.col("n") >= least)).isEmpty():
        seed += 1
    return seed


@dataclass
class Names:
    """Languages, words and counts of the held words, by id."""

    lang: pa.Array
    word: pa.Array
    n: pa.Array

    def of(self, rows: DataFrame, coded: DataFrame | None, codes: str) -> DataFrame:
        """rows with `lang`, and for each of their codes, x for example, its word and count as `word_x` and `n_x`.

        Rows of ids only are named in tasks. The others, if there are any, are joined with `coded`, the words that have no id among them.
        """
        held = F.least(*(F.col(c) for c in codes), F.lit(0)) >= 0
        fields = [*rows.schema.fields, *StructType.fromDDL(", ".join(["lang string", *(f"word_{c} string, n_{c} long" for c in codes)])).fields]
        places = [rows.columns.index(c) for c in codes]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [batch.column(k) for k in places]
                new = [self.lang.take(ids[0]), *(x.take(i) for i in ids for x in (self.word, self.n))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[f.name for f in fields])

        named = in_arrow(rows.where(held), run, StructType(fields))
        if coded is None:
            return named
        rest = rows.where(~held)
        for k, c in enumerate(codes):
            known = coded.select(F.col("code").alias(c), F.col("word").alias(f"word_{c}"), F.col("n").alias(f"n_{c}"), *([] if k else ["lang"]))
            rest = rest.join(known, c)
        return named.unionByName(rest.select(*named.columns))


def _vocabulary(frequent: DataFrame, seed: int, most: int) -> tuple[Vocabulary, Names, DataFrame | None]:
    """What tasks hold, and, if that isn't all, a table of all frequent words with their codes: lang, word, n, code."""
    hashed = frequent.withColumn("hash", hash_column(seed))
    held = heaviest(hashed, "n", most).select("hash", "n", "lang", "word").toArrow()  # `most` rows at most
    h, n = (held[c].to_numpy() for c in ("hash", "n"))
    rank = np.lexsort((h, -n))
    ids = np.empty(len(h), dtype=np.int64)
    ids[rank] = np.arange(len(h))
    order = np.argsort(h)
    names = Names(*(held[c].combine_chunks().take(pa.array(rank)) for c in ("lang", "word", "n")))
    if len(h) == frequent.count():
        return Vocabulary(seed, h[order], ids[order], None), names, None
    vocabulary = Vocabulary(seed, h[order], ids[order], Bitmap(hashed, "hash"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("hash").to_numpy()
            held = vocabulary.find(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.where(held >= 0, held, -2 - found))], names=["lang", "word", "n", "code"])

    return vocabulary, names, written(in_arrow(hashed.select("lang", "word", "n", "hash"), code, "lang string, word string, n long, code long"), "coded")


def _coded(part: pa.RecordBatch, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The code of each word of a slice, and whether the next word is in the same piece."""
    words, langs, lang, word, at = _by_lang(part)
    code = vocabulary.codes(langs.to_pylist(), lang, words.distinct, word)[at]
    return code, words.piece[1:] == words.piece[:-1]


def _batch(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = ["x", "y", "z", "n"] if len(columns) == 4 else ["x", "y", "n"]
    for k in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)], pa.int64()) for c in columns], names=names)


def pair_counts(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """x, y, n: codes of neighbours and how often they are that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, apart = Tiles(), Apart()
        for batch in batches:
            for part in slices(batch, TEXTS):
                code, joined = _coded(part, vocabulary)
                x, y = code[:-1], code[1:]
                fit = joined & (x != -1) & (y != -1)
                ids = fit & (x >= 0) & (y >= 0)
                for found in (tiles.add(x[ids], y[ids]), apart.add(x[fit & ~ids], y[fit & ~ids])):
                    for columns in found:
                        yield from _batch(*columns)
        for counts in (tiles, apart):
            for columns in counts.rest():
                yield from _batch(*columns)

    return in_arrow(rows, run, "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))


def _ranked(rows: DataFrame, most: int) -> tuple[np.ndarray, ...]:
    """Keys of the pairs that tasks hold, in order, with their ids; words by id. rows: pairs of ids."""
    held = heaviest(rows, "n", most).select(F.expr(f"shiftleft(x, {WORD_BITS}) | y").alias("key"), "n").toArrow()  # `most` rows at most
    key, n = (held[c].to_numpy() for c in ("key", "n"))
    del held
    rank = np.lexsort((key, -n))
    ids = np.empty(len(key), dtype=np.int32)
    ids[rank] = np.arange(len(key), dtype=np.int32)
    left, right = ((key >> WORD_BITS).astype(np.int32)[rank], (key & (1 << WORD_BITS) - 1).astype(np.int32)[rank])
    order = np.argsort(key)
    return key[order], ids[order], left, right


def _pairs(frequent: DataFrame, most: int) -> Pairs:
    """Frequent pairs ranked anew. frequent: x, y, n."""
    held = _ranked(frequent.where("x >= 0 and y >= 0"), most)
    others = None
    if len(held[0]) < frequent.count():
        give_back()  # what ranking took, before the bitmap comes
        hashes = lambda batches: (pa.RecordBatch.from_arrays([pa.array(pair_hash(b.column(0).to_numpy(), b.column(1).to_numpy()))], names=["hash"]) for b in batches)
        others = Bitmap(written(in_arrow(frequent.select("x", "y"), hashes, "hash long"), "hashes"), "hash")
    return Pairs(*held, others)


def triple_counts(rows: DataFrame, vocabulary: Vocabulary, pairs: Pairs) -> DataFrame:
    """x, y, z, n: codes of three neighbours of which both pairs are frequent, or may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, apart = Tiles(), Apart()
        split_pairs = lambda p, z, n: _batch(pairs.left[p], pairs.right[p], z, n)
        for batch in batches:
            for part in slices(batch, TEXTS):
                code, joined = _coded(part, vocabulary)
                pair = np.full(max(0, len(code) - 1), -1, dtype=np.int64)
                at = np.flatnonzero(joined)
                pair[at] = pairs.codes(code[at], code[at + 1])
                p, z = pair[:-1], code[2:]
                fit = (p != -1) & (pair[1:] != -1)
                ids = fit & (p >= 0) & (z >= 0)
                away = np.flatnonzero(fit & ~ids)
                for columns in tiles.add(p[ids], z[ids]):
                    yield from split_pairs(*columns)
                for columns in apart.add(code[away], code[away + 1], code[away + 2]):
                    yield from _batch(*columns)
        for columns in tiles.rest():
            yield from split_pairs(*columns)
        for columns in apart.rest():
            yield from _batch(*columns)

    return in_arrow(rows, run, "x long, y long, z long, n long").groupBy("x", "y", "z").agg(F.sum("n").alias("n"))


def _score(a: str, left: str, right: str) -> Column:
    d = lambda c: f"cast({c} as decimal(18, 0))"  # noqa: E731  products have 37 digits at most
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * (cast({a} as decimal(15, 0)) * cast({a} as decimal(15, 0)))) div ({d(left)} * {d(right)})")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, text: str = "text", lang: str = "lang", *, held_words: int = HELD_WORDS, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score. held_words, held_pairs: what tasks hold; the result doesn't depend on it."""
    rows = _rows(docs, text, lang)
    words = written(word_counts(rows), "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    vocabulary, names, coded = _vocabulary(frequent, _seed(words, least), min(held_words, 1 << WORD_BITS))
    give_back()  # the driver's copies of what tasks hold
    pairs = written(pair_counts(rows, vocabulary).where(F.col("n") >= least), "pairs")
    triples = written(triple_counts(rows, vocabulary, _pairs(pairs, held_pairs)).where(F.col("n") >= least), "triples")
    give_back()

    # the most frequent phrase around each pair
    around = triples.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("z").alias("y")))).alias("p"), "n").groupBy("p.x", "p.y").agg(F.max("n").alias("around"))
    twos = pairs.join(around, ["x", "y"], "left").where(F.coalesce(100 * F.col("around") < share * F.col("n"), F.lit(True))).select("x", "y", F.col("n").alias("a"))
    twos = names.of(twos, coded, "xy").select("lang", F.concat_ws(" ", "word_x", "word_y").alias("phrase"), "a", F.col("n_x").alias("l"), F.col("n_y").alias("r"))
    twos = twos.withColumn("score", _score("a", "l", "r"))
    # a phrase of three: cut behind its first word, or before its last
    heads = pairs.select("x", "y", F.col("n").alias("n_xy"))
    tails = pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("n").alias("n_yz"))
    threes = triples.withColumnRenamed("n", "a").join(heads, ["x", "y"]).join(tails, ["y", "z"])
    threes = names.of(threes, coded, "xyz").withColumn("first", _score("a", "n_x", "n_yz")).withColumn("second", _score("a", "n_xy", "n_z"))
    early = F.col("first") <= F.col("second")
    threes = threes.select(
        "lang", F.concat_ws(" ", "word_x", "word_y", "word_z").alias("phrase"), "a",
        F.when(early, F.col("n_x")).otherwise(F.col("n_xy")).alias("l"), F.when(early, F.col("n_yz")).otherwise(F.col("n_z")).alias("r"), F.least("first", "second").alias("score"),
    )
    every = twos.unionByName(threes)
    order = (F.desc("score"), F.desc("a"), "phrase")
    # the first of each part of a language, then of the language: no task gets more than PARTS times `top`
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = every.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    found = written(best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    dropped(words, pairs, triples, *([] if coded is None else [coded]))
    return found


#: Parts of a language that are ranked by themselves first.
PARTS = 32
