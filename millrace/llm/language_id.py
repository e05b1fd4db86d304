"""Language identification with a string kernel, Nystroem landmarks and kernel ridge regression.

A text, lower-cased and with everything that is no letter as a blank, is the set of its n-grams of 1 to 4 bytes of
UTF-8 (blended spectrum, presence only). The kernel of two texts is the number of n-grams that both have, divided by the
geometric mean of their numbers; only n-grams that some landmark has count.

1. Landmarks: a few texts of each language, in order of a hash of the id, those of at most LANDMARK_BYTES first.
2. The kernel of `sample` texts, dealt out evenly over the languages, with all landmarks is found in tasks. The landmarks' own kernel,
   to the power -1/2, maps these rows to features; one ridge regression for each language against the rest has targets 0 and 1.
3. The kernel is linear in presence, so landmarks, feature map and regressions are multiplied up into one weight for each n-gram and language.
   Tasks put a batch of texts into a matrix of presence and multiply it by these weights: what comes out is the kernel regression itself.

Only documents whose crc32(id) mod `folds` isn't `fold`, with an id and a language, are learnt from; what is predicted depends on the text alone.
`sample` and `landmarks` bound what is learnt from; every document is predicted, by its whole text.

Defined results: null texts and texts without a letter are `und` with score 0, and so are all where there is nothing to learn from. Rows
repeated under one id are each predicted, alike. A null id counts as empty text in the split. An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import map_slices
from millrace.llm.words import buffer_of

UNKNOWN = "und"

#: Bytes of an n-gram, of the texts that are landmarks first, and bytes of a text that are looked at together.
GRAM, LANDMARK_BYTES, WINDOW = 4, 8192, 1 << 20

#: Texts of a matrix of presence.
BATCH = 64

#: Slots of a level of the table of n-grams, a power of two.
SLOT_BITS = 18

#: ASCII that is no letter is a blank.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each between blanks and with three bytes 0 behind it, and where each begins and the last one ends."""
    data, starts = buffer_of(pc.utf8_lower(texts.cast(pa.large_string())))
    data = np.frombuffer(data.tobytes().translate(_LETTERS), dtype=np.uint8)
    blank = data == 32
    again = np.append(True, blank[:-1])[: len(data)]
    again[starts[:-1][starts[:-1] < len(data)]] = True  # a text begins behind a blank
    keep = ~(blank & again)
    before = np.append(0, np.cumsum(keep))[starts]
    bounds = before + (GRAM + 1) * np.arange(len(starts))
    out = np.zeros(bounds[-1], dtype=np.uint8)
    of = np.repeat(np.arange(len(texts)), np.diff(before))
    out[np.arange(before[-1]) + (GRAM + 1) * of + 1] = data[keep]
    out[bounds[:-1]] = 32
    out[bounds[1:] - GRAM] = 32
    return out, bounds


def codes(data: np.ndarray) -> np.ndarray:
    """The n-gram of GRAM bytes at each place but the last ones. Shorter ones are its low bytes; bytes 0 behind a text make it a shorter one."""
    x = data.astype(np.uint32)
    n = len(x) - GRAM + 1
    return x[:n] | x[1 : n + 1] << 8 | x[2 : n + 2] << 16 | x[3 : n + 3] << 24


class Grams:
    """Numbers of known n-grams. A table by hash; n-grams whose slot is taken are in the next level's table."""

    def __init__(self, known: np.ndarray):
        self.size, self.levels = len(known), []
        left, number = known.astype(np.uint32), np.arange(len(known), dtype=np.int32)
        while len(left) or not self.levels:
            odd = np.uint32(2654435761 + 2 * 7919 * len(self.levels))
            slot = self._slots(left, odd)
            _, first = np.unique(slot, return_index=True)
            code, at = np.zeros(1 << SLOT_BITS, dtype=np.uint32), np.full(1 << SLOT_BITS, -1, dtype=np.int32)
            code[slot[first]], at[slot[first]] = left[first], number[first]
            self.levels.append((odd, code, at))
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, number = left[rest], number[rest]

    @staticmethod
    def _slots(code: np.ndarray, odd: np.uint32) -> np.ndarray:
        return ((code ^ code >> np.uint32(15)) * odd) >> np.uint32(32 - SLOT_BITS)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in code that hold known n-grams, and their numbers."""
        places, numbers = [], []
        at = np.arange(len(code))
        for odd, held, number in self.levels:
            slot = self._slots(code, odd)
            hit = (held[slot] == code) & (number[slot] >= 0)
            places.append(at[hit])
            numbers.append(number[slot[hit]])
            at, code = at[~hit], code[~hit]
        return np.concatenate(places), np.concatenate(numbers)

    def presence(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A row for each text of normal(): 1 for n-grams that it has."""
        out = np.zeros((len(bounds) - 1, self.size), dtype=np.float32)
        for start in range(int(bounds[0]), int(bounds[-1]), WINDOW):
            long = codes(data[start : min(start + WINDOW + GRAM - 1, bounds[-1])])
            of = np.searchsorted(bounds, np.arange(start, start + len(long)), side="right") - 1 if len(out) > 1 else np.zeros(len(long), dtype=np.int64)
            for n in range(1, GRAM + 1):
                at, number = self.find(long & np.uint32((1 << 8 * n) - 1))
                out[of[at], number] = 1
        return out


def grams_of(text: str) -> np.ndarray:
    """Distinct n-grams of one text."""
    long = codes(normal(pa.array([text]))[0])
    every = np.unique(np.concatenate([long & np.uint32((1 << 8 * n) - 1) for n in range(1, GRAM + 1)]))
    return every[every & 255 > 0]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Landmarks:
    """Texts that others are compared with: their n-grams, and which of them each has."""

    def __init__(self, texts: list[str]):
        sets = [grams_of(t) for t in texts]
        known = np.unique(np.concatenate([np.zeros(0, dtype=np.uint32), *sets]))
        self.grams = Grams(known)
        self.has = np.zeros((len(known), len(texts)), dtype=np.float32)
        for k, s in enumerate(sets):
            self.has[np.searchsorted(known, s), k] = 1

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        """Rows of the kernel of texts with the landmarks."""
        sizes = np.outer(presence.sum(axis=1), self.has.sum(axis=0))
        return presence @ self.has / np.sqrt(np.maximum(sizes, 1))


def fit(landmarks: Landmarks, kernel: np.ndarray, target: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of n-grams (by language) and constants. kernel: rows of training texts; target: 0 and 1 for each language."""
    own = landmarks.kernel(landmarks.has.T).astype(float)
    value, vector = np.linalg.eigh(own)
    keep = value > 1e-6 * value.max()
    feature = vector[:, keep] / np.sqrt(value[keep])  # the landmarks' kernel to the power -1/2
    x = kernel @ feature
    mean, level = x.mean(axis=0), target.mean(axis=0)
    x = x - mean
    solved = np.linalg.solve(x.T @ x + ridge * len(x) * np.eye(x.shape[1]), x.T @ (target - level))
    of_landmarks = feature @ solved / np.sqrt(np.maximum(landmarks.has.sum(axis=0), 1))[:, None]
    return (landmarks.has @ of_landmarks).astype(np.float32), level - mean @ solved


class Model:
    def __init__(self, langs: list[str], grams: Grams | None = None, weights: np.ndarray | None = None, constants: np.ndarray | None = None):
        self.langs, self.grams, self.weights, self.constants = langs, grams, weights, constants

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        known = np.array([has_letter(t) for t in texts.to_pylist()], dtype=bool)
        lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
        if not self.langs or not known.any():
            return lang.tolist(), score
        rows = np.flatnonzero(known)
        data, bounds = normal(texts.take(pa.array(rows)))
        for k in range(0, len(rows), BATCH):
            has = self.grams.presence(data, bounds[k : k + BATCH + 1])
            value = has @ self.weights / np.sqrt(np.maximum(has.sum(axis=1), 1))[:, None] + self.constants
            best = value.argmax(axis=1)
            lang[rows[k : k + BATCH]] = np.array(self.langs, dtype=object)[best]
            score[rows[k : k + BATCH]] = np.clip(value[np.arange(len(best)), best], 0, 1)
        return lang.tolist(), score


def _first(rows: DataFrame, quota: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= quota).drop("rank")


def train(rows: DataFrame, landmarks: int = 256, sample: int = 8000, ridge: float = 1e-4) -> Model:
    """rows: doc_id, text, lang, of which all may be learnt from. At least one landmark and eight texts of each language are."""
    rows = rows.where("doc_id is not null and lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(counts)
    if not langs:
        return Model([])
    some, quota = max(1, landmarks // len(langs)), max(8, sample // len(langs))
    hashed = rows.withColumn("hash", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    # a margin by the hash, and the exact bound behind it
    share = rows.sparkSession.createDataFrame([(x, int((1 << 30) * min(1.0, 1.2 * quota / n + 8 / n))) for x, n in counts.items()], "lang string, most long")
    drawn = hashed.join(F.broadcast(share), "lang").where(F.col("hash") <= F.col("most")).drop("most")
    size = F.octet_length("text")
    chosen = _first(drawn.select("lang", "doc_id", "hash", size.alias("size")), some, F.greatest("size", F.lit(LANDMARK_BYTES)), "hash", "doc_id", "size").drop("hash").collect()
    texts = hashed.where(F.col("doc_id").isin(sorted({r["doc_id"] for r in chosen}))).select("lang", "doc_id", size.alias("size"), "text")
    found = texts.groupBy("lang", "doc_id", "size").agg(F.min("text").alias("text")).collect()
    wanted = {tuple(r) for r in chosen}
    found = Landmarks([r["text"] for r in sorted(found) if (r["lang"], r["doc_id"], r["size"]) in wanted])

    def make():
        def step(part: pa.RecordBatch) -> dict:
            data, bounds = normal(part.column("text"))
            kernel = np.concatenate([found.kernel(found.grams.presence(data, bounds[k : k + BATCH + 1])) for k in range(0, part.num_rows, BATCH)]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * kernel.shape[1], pa.int32()), pa.array(kernel.ravel()))
            return {"lang": part.column("lang"), "doc_id": part.column("doc_id"), "hash": part.column("hash"), "kernel": lists}

        return step

    compared = map_slices(drawn.select("lang", "doc_id", "hash", "text"), make, "lang string, doc_id long, hash long, kernel array<float>")
    table = _first(compared, quota, "hash", "doc_id", "kernel").orderBy("lang", "hash", "doc_id", "kernel").toArrow()  # rows of `landmarks` numbers, `sample` of them or eight for each language
    kernel = table["kernel"].combine_chunks().flatten().to_numpy().reshape(len(table), -1).astype(float)
    told = kernel.any(axis=1)  # a text without a known n-gram tells nothing
    if not told.any():
        return Model([])
    target = np.array(table["lang"].to_pylist(), dtype=object)[told][:, None] == np.array(langs, dtype=object)
    return Model(langs, found.grams, *fit(found, kernel[told], target.astype(float), ridge))


def identify(docs: DataFrame, landmarks: int = 256, sample: int = 8000, ridge: float = 1e-4, folds: int = 3, fold: int = 1, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold
    model = train(rows.where(~out), landmarks, sample, ridge)

    def make():
        def step(part: pa.RecordBatch) -> dict:
            found, score = model(part.column("text"))
            return {"doc_id": part.column("doc_id"), "held_out": [held_out(i, folds, fold) for i in part.column("doc_id").to_pylist()], "lang_pred": found, "score": score}

        return step

    return map_slices(rows.select("doc_id", "text"), make, "doc_id long, held_out boolean, lang_pred string, score double")
