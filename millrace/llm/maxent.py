"""Language model scoring with a hashed maximum-entropy model.

Texts are lower-cased in A-Z; tokens are runs of characters other than blanks, then one end.

Vocabulary: tokens of all training documents are counted in tasks and summed by token. The
table of counts stays distributed. What tasks hold is bounded: the KNOWN most frequent tokens, of which
at most LEAVES are outcomes of the model. Counts of all other tokens are joined to the documents that have them.

Model: outcomes are the leaves of a Huffman tree with FAN branches at each node, so the softmax is factored
into as many small ones: class, class in the class, and so on, and frequent tokens have short ways. At each
node the scores of its branches are sums of weights of features: the last token, the one before it by
itself (a skip), the last two tokens together, the third-last by itself (a skip), and none (a bias). Rows
of weights are found by hashing feature and node; there are ROWS of a small vocabulary, and up to
MOST_ROWS of a large one, which bounds what a task and the driver hold. All tokens outside the
frequent ones share KINDS leaves by their look; within its kind, a
token has the probability (c + 1) / (C + V + 1), C and V being the kind's tokens and distinct
tokens, so one unseen token of each kind has a share, and everything sums to 1.

Training: each task takes adaptive gradient steps over its documents, weights are averaged by how
often a row was updated, and the next round starts from the average. Every training document
is used once, in the round that its id's hash gives. A task has SPLITS splits of the table, whatever the
size of table and cluster.

Defined results: a null text is empty and has one token, its end. A null id counts as empty text in
the split. Rows repeated under one id are each scored and learnt from. An empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_arrow, map_slices, slices, written

FAN, KINDS = 16, 16
#: Tokens that are outcomes, and tokens whose counts tasks hold, at most.
LEAVES, KNOWN = FAN**4 - KINDS, 1 << 17
#: Rows of weights, FAN each, of a small vocabulary, and the most of a large one.
ROWS, MOST_ROWS = 1 << 16, 1 << 18
#: Tokens of a gradient step, a power of two. Places in a step's rows fit in 16 bits.
STEP = 8192
#: Rows of weights that travel together.
CHUNK = 2048
#: Splits of the table that a training task reads.
SPLITS = 4
#: Texts that are split into tokens at a time, and words of such texts whose counts are summed at a time.
TEXTS, COUNTED = 2048, 1_000_000
#: The end of a text; no token is empty.
END = b""
FEATURES = 5

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_MARKS = ("äöüß", "éèêçàùâîôû", "ñóíáú¿¡")
#: What a token ends with, by its last byte: 1 and 2 for full stop and comma, 3 for what else isn't a letter.
_ENDS = np.array([1 if b == 46 else 2 if b == 44 else 3 if b < 128 and not chr(b).isalpha() else 0 for b in range(256)])
_ONES = np.ones(FAN, dtype=np.float32)


def held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def _part(word: str, parts: int) -> F.Column:
    """Remainder of the checksum of a word and the id, as held_out has it."""
    return F.crc32(F.concat(F.lit(word), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")) % parts


def kinds(words: pa.Array) -> np.ndarray:
    """How tokens look: their letters' marks, and what they end with."""
    words = words.cast(pa.string())
    bounds = np.frombuffer(words.buffers()[1], dtype=np.int32, count=len(words) + words.offset + 1)[words.offset :]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    full = np.diff(bounds) > 0
    out = np.zeros(len(words), dtype=np.int64)
    out[full] = _ENDS[data[bounds[1:][full] - 1]]
    other = np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False))
    marked = words.take(pa.array(other))
    for k in range(len(_MARKS), 0, -1):  # the first that fits counts
        some = other[pc.match_substring_regex(marked, f"[{_MARKS[k - 1]}]").to_numpy(zero_copy_only=False)]
        out[some] = out[some] % 4 + 4 * k
    return out


def tokens(text: str | None) -> list[bytes]:
    found = (text or "").encode().lower().split()
    found.append(END)
    return found


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens of the texts, each token's place among them, and where texts begin. What tokens() gives, for a column."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = words.flatten().cast(pa.large_binary() if pa.types.is_large_list(words.type) else pa.binary())
    full = pc.binary_length(flat).to_numpy() > 0  # blanks at a text's ends give empty words
    bounds = np.concatenate([[0], np.cumsum(full)])[words.offsets.to_numpy()]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    starts = bounds[:-1] + np.arange(len(texts))
    out = np.full(bounds[-1] + len(texts), len(coded.dictionary), dtype=np.int64)  # the end, behind each text
    out[np.arange(bounds[-1]) + np.repeat(np.arange(len(texts)), np.diff(bounds))] = coded.indices.to_numpy()
    return pa.concat_arrays([coded.dictionary, pa.array([END], coded.dictionary.type)]).cast(pa.binary()), out, starts


def n_rows(vocabulary: int) -> int:
    """Rows of weights for so many distinct tokens."""
    rows = ROWS
    while rows < vocabulary and rows < MOST_ROWS:
        rows *= 2
    return rows


class Tree:
    """A Huffman tree with FAN branches at each node: frequent outcomes have short ways. Their number less one is a multiple of FAN - 1."""

    def __init__(self, frequency: Sequence[float], order: Sequence | None = None):
        """order: a key for each outcome; of those with ways of one length, neighbours in it share classes."""
        n = len(frequency)
        heap = [(float(x), k) for k, x in enumerate(frequency)]
        heapq.heapify(heap)
        above, top = {}, n
        while len(heap) > 1:
            some = [heapq.heappop(heap) for _ in range(FAN)]
            above.update((k, top) for _, k in some)
            heapq.heappush(heap, (sum(x for x, _ in some), top))
            top += 1
        depth = np.zeros(top, dtype=np.uint8)
        for k in range(top - 2, -1, -1):
            depth[k] = depth[above[k]] + 1
        self.depth = depth[:n]
        # ways of these lengths, in order of length and key: each is the number after the last one, with digits added where it is longer
        found = sorted(range(n), key=lambda k: (depth[k], k if order is None else order[k]))
        ways, way, last = np.zeros(n, dtype=np.int64), -1, int(depth[found[0]])
        for k in found:
            way = (way + 1) * FAN ** (int(depth[k]) - last)
            ways[k], last = way, int(depth[k])
        self.nodes = np.zeros((max(1, last), n), dtype=np.uint16)
        self.branches = np.zeros(self.nodes.shape, dtype=np.uint8)
        first = 0  # number of a level's first node
        for level in range(last):
            live = self.depth > level
            digits = ways[live] // FAN ** (self.depth[live].astype(np.int64) - 1 - level)
            inner, at = np.unique(digits // FAN, return_inverse=True)
            self.nodes[level, live], self.branches[level, live] = at + first, digits % FAN
            first += len(inner)

    def __len__(self) -> int:
        return len(self.depth)

    def levels(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level, the places of outcomes that have it, their nodes and branches."""
        live = np.arange(len(ids))
        for level in range(len(self.nodes)):
            live = live[self.depth[ids[live]] > level]
            if not len(live):
                return
            at = ids[live]
            yield live, self.nodes[level].take(at), self.branches[level].take(at)


def contexts(ids: np.ndarray, starts: np.ndarray, outcomes: int) -> np.ndarray:
    """The features' values for each token: FEATURES rows, the last of them the bias. starts: where texts begin; before them stands the outcome `outcomes`."""
    ids = ids.astype(np.uint64)
    out = np.zeros((FEATURES, len(ids)), dtype=np.uint64)
    back = []
    for k in (1, 2, 3):
        prior = np.full(len(ids), outcomes, dtype=np.uint64)
        prior[k:] = ids[:-k] if len(ids) > k else ids[:0]
        for d in range(k):  # the first k tokens of a text have none so far back
            at = starts + d
            prior[at[at < len(ids)]] = outcomes
        back.append(prior)
    out[:2] = back[:2]
    out[2] = back[0] * np.uint64(outcomes + 1) + back[1]
    out[3] = back[2]
    return out


def mixed(context: np.ndarray) -> np.ndarray:
    """The features' values, each mixed with its number."""
    return (context + np.arange(1, FEATURES + 1, dtype=np.uint64)[:, None] * _C) * _A


def rows_of(values: np.ndarray, node: np.ndarray, count: int = ROWS) -> np.ndarray:
    """Rows of weights, of a power of two, of each mixed feature at each token's node."""
    x = values + node * _B
    x ^= x >> np.uint64(29)
    x *= _C
    x >>= np.uint64(65 - count.bit_length())
    return x


def _odds(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each branch's chance is in proportion to, and the sums."""
    rows = rows.view(np.int64)
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    np.clip(z, -30, 30, out=z)  # no overflow, and cheaper than to take each row's largest
    np.exp(z, out=z)
    return z, z @ _ONES  # a product sums short rows faster


def _chances(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z, total = _odds(weights, rows)
    z /= total[:, None]
    return z


def log_chances(weights: np.ndarray, ids: np.ndarray, context: np.ndarray, tree: Tree) -> np.ndarray:
    """log10 of each outcome's probability."""
    total, values = np.zeros(len(ids)), mixed(context)
    for live, node, branch in tree.levels(ids):
        z, whole = _odds(weights, rows_of(values.take(live, axis=1), node, len(weights)))
        total[live] += np.log10(np.maximum(z[np.arange(len(live)), branch] / whole, 1e-30))
    return total


def _sums(rows: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row numbers and the sum of error over the tokens that use each. rows: FEATURES x tokens, STEP of them at most."""
    place = np.arange(FEATURES, dtype=np.uint64)[:, None] * np.uint64(STEP) + np.arange(rows.shape[1], dtype=np.uint64)
    both = np.sort((rows << np.uint64(16) | place).ravel())  # quicker than to sort places by rows
    token = (both & np.uint64(STEP - 1)).view(np.int64)
    both >>= np.uint64(16)
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    times = np.diff(np.append(first, len(both)))
    order = np.argsort((0xFFFF - times).astype(np.uint16), kind="stable")  # rows of most tokens first, so those that have a kth are in front
    first, times = first.take(order), times.take(order)
    out = error.take(token.take(first), axis=0)
    nth, many = 1, int(np.searchsorted(-times, -1, side="left"))
    while many > 48:
        out[:many] += error.take(token.take(first[:many] + nth), axis=0)
        nth += 1
        many = int(np.searchsorted(-times[:many], -nth, side="left"))
    for k in range(many):
        out[k] += error.take(token[first[k] + nth : first[k] + times[k]], axis=0).sum(axis=0)
    return both.take(first).view(np.int64), out


class Trainer:
    def __init__(self, weights: np.ndarray, rate: float, tree: Tree):
        self.weights, self.rate, self.tree = weights.copy(), rate, tree
        self.rows = self.weights.view(f"V{4 * FAN}").ravel()  # a row as one value is put in place faster
        self.squares = np.full(len(weights), 1.0, dtype=np.float32)
        self.updates = np.zeros(len(weights), dtype=np.float32)

    def step(self, ids: np.ndarray, context: np.ndarray) -> None:
        values = mixed(context)
        for live, node, branch in self.tree.levels(ids):
            rows = rows_of(values.take(live, axis=1), node, len(self.weights))
            error = _chances(self.weights, rows)
            error[np.arange(len(live)), branch] -= 1
            used, gradient = _sums(rows, error)
            squares = self.squares.take(used) + (gradient * gradient) @ _ONES / FAN
            self.squares[used] = squares
            gradient *= (-self.rate / np.sqrt(squares))[:, None]
            gradient += self.weights.take(used, axis=0)
            self.rows[used] = gradient.view(self.rows.dtype).ravel()
            self.updates[used] += 1


class Coder:
    """Outcomes of tokens. known: tokens by falling frequency, of which the first `leaves` are outcomes."""

    def __init__(self, known: list[bytes], leaves: int):
        self.known, self.leaves = pa.array(known, pa.binary()), leaves

    def __call__(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Outcome, and rank among the known or -1, of each token."""
        rank = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy().astype(np.int64)
        away = np.flatnonzero((rank < 0) | (rank >= self.leaves))
        ids = rank + KINDS
        ids[away] = kinds(distinct.take(pa.array(away)))
        return ids, rank


def _counts(rows: DataFrame) -> DataFrame:
    """word, c over the training documents. Tasks sum up as many words as COUNTED at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            summed = pa.concat_tables(found).group_by("word", use_threads=False).aggregate([("c", "sum")])
            found.clear()
            yield from pa.table({"word": summed["word"], "c": summed["c_sum"]}).to_batches(max_chunksize=1 << 16)

        for batch in batches:
            for part in slices(batch, TEXTS):
                words, places, _ = coded(part.column(0))
                found.append(pa.table({"word": words, "c": np.bincount(places, minlength=len(words))}))
                size += len(words)
            if size > COUNTED:
                yield from flush()
                size = 0
        if found:
            yield from flush()

    found = in_arrow(rows.where(_part("", 7) != 2).select("text"), run, "word binary, c long")
    return found.groupBy("word").agg(F.sum("c").alias("c"))


def _kinds(words: DataFrame) -> np.ndarray:
    """Tokens and distinct tokens of each kind."""

    def make():
        def step(part: pa.RecordBatch) -> dict:
            kind = kinds(part.column("word"))
            tokens = np.zeros(KINDS, dtype=np.int64)
            np.add.at(tokens, kind, part.column("c").to_numpy())
            return {"kind": np.arange(KINDS), "tokens": tokens, "types": np.bincount(kind, minlength=KINDS)}

        return step

    found = map_slices(words.select("word", "c"), make, "kind int, tokens long, types long", rows=1 << 16).groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
    out = np.zeros((KINDS, 2))
    for r in found.collect():
        out[r["kind"]] = r["tokens"], r["types"]
    return out


def _round(rows: DataFrame, known: list[bytes], leaves: int, weights: np.ndarray, tree: Tree, number: int, rounds: int, rate: float) -> np.ndarray:
    """Weights after one round over the training documents that belong to it."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, trainer = Coder(known[:leaves], leaves), Trainer(weights, rate, tree)
        for batch in batches:
            for part in slices(batch, TEXTS):
                distinct, places, starts = coded(part.column(0))
                ids = coder(distinct)[0][places]
                context = contexts(ids, starts, len(tree))
                for k in range(0, len(ids), STEP):
                    trainer.step(ids[k : k + STEP], context[:, k : k + STEP])
        for k in range(0, len(weights), CHUNK):
            times = trainer.updates[k : k + CHUNK]
            if times.any():
                moved = (trainer.weights[k : k + CHUNK] * times[:, None]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in ((k, pa.int32()), (moved, pa.binary()), (times.tobytes(), pa.binary()))], names=["chunk", "moved", "times"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, w, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                w, n = np.frombuffer(w, dtype=np.float32).reshape(-1, FAN), np.frombuffer(n, dtype=np.float32)
                if k in sums:
                    sums[k][0] += w
                    sums[k][1] += n
                else:
                    sums[k] = [w.astype(np.float64), n.astype(np.float64)]
        out = [(k, np.where(n[:, None] > 0, w / np.maximum(n, 1)[:, None], 0).astype(np.float32).tobytes(), (n > 0).tobytes()) for k, (w, n) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], type=t) for c, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "moved", "times"])

    tasks = -(-rows.rdd.getNumPartitions() // SPLITS) or 1
    schema = "chunk int, moved binary, times binary"
    mine = rows.where((_part("", 7) != 2) & (_part("round ", rounds) == number)).select("text")
    learnt = in_arrow(mine.coalesce(tasks), learn, schema)
    found = in_arrow(learnt.repartition("chunk"), average, schema).collect()  # MOST_ROWS rows of weights at most
    new = weights.copy()
    for r in found:
        at = slice(r["chunk"], r["chunk"] + CHUNK)
        used = np.frombuffer(r["times"], dtype=bool)
        new[at][used] = np.frombuffer(r["moved"], dtype=np.float32).reshape(-1, FAN)[used]
    return new


def _top(words: DataFrame) -> DataFrame:
    """The words tasks hold: the most frequent ones, KNOWN at most. All words of about one count are in or out together."""
    shift = F.greatest(F.length(F.bin("c")) - 11, F.lit(0))
    # counts up to 2047 by themselves, larger ones by their first 11 bits: 120,000 classes at most, in order of counts
    band = (F.expr("shiftright(c, int(greatest(length(bin(c)) - 11, 0)))") + shift * 2048).cast("int")
    banded = words.select("word", "c", band.alias("band"))
    held, least = 0, None
    for r in banded.groupBy("band").count().orderBy(F.desc("band")).collect():
        if held + r["count"] > KNOWN:
            break
        held, least = held + r["count"], r["band"]
    if least is None:  # more than KNOWN words share the largest counts
        return words.orderBy(F.desc("c"), "word").limit(KNOWN)
    return banded.where(F.col("band") >= least).select("word", "c")


def score_texts(docs: DataFrame, rounds: int = 2, rate: float = 0.3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    words = written(_counts(rows), "words")
    size, total = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    top = sorted(((bytes(r["word"]), r["c"]) for r in _top(words).collect()), key=lambda x: (-x[1], x[0]))  # KNOWN rows at most
    known, counts = [w for w, _ in top], np.array([c for _, c in top], dtype=np.int64)
    leaves = min(LEAVES, len(known)) // (FAN - 1) * (FAN - 1)  # with KINDS more, no branch of the tree is without an outcome
    # tokens and distinct tokens of each kind, without those that have a leaf
    mass = _kinds(words)
    if leaves:
        np.subtract.at(mass, kinds(pa.array(known[:leaves], pa.binary())), np.stack([counts[:leaves], np.ones(leaves)], axis=1))
    shares = np.log10(mass.sum(axis=1) + 1)
    tree = Tree([*(mass[:, 0] + 1), *counts[:leaves]], [*[b""] * KINDS, *known[:leaves]])

    weights = np.zeros((n_rows(size), FAN), dtype=np.float32)
    for k in range(rounds if size else 0):
        weights = _round(rows, known, leaves, weights, tree, k, rounds, rate)

    def make():
        coder = Coder(known, leaves)
        chance = np.append(np.log10(counts + 1.0), 0.0)  # the last for those that aren't known
        first = TaskContext.get().partitionId() << 33
        seen = 0

        def step(part: pa.RecordBatch) -> dict:
            nonlocal seen
            n = part.num_rows
            distinct, places, starts = coded(part.column("text"))
            outcome, rank = coder(distinct)
            ids, rank = outcome[places], rank[places]
            context = contexts(ids, starts, len(tree))
            # a kind's leaf leaves (c + 1) / share of the kind to the token
            each = np.concatenate([log_chances(weights, ids[k : k + STEP], context[:, k : k + STEP], tree) for k in range(0, len(ids), STEP)])
            outside, found, logs = ids < KINDS, rank >= 0, chance[rank]
            each[outside] += logs[outside] - shares[ids[outside]]
            # the other tokens, counted by text
            text_of = np.repeat(np.arange(n), np.diff(np.append(starts, len(ids))))
            away, times = np.unique(text_of[~found] * len(distinct) + places[~found], return_counts=True)
            bounds = np.searchsorted(away // len(distinct), np.arange(n + 1))
            rest = pa.StructArray.from_arrays([distinct.take(pa.array(away % len(distinct))), pa.array(times)], ["word", "n"])
            out = {
                "row": np.arange(n) + (first + seen),
                "doc_id": part.column("doc_id"),
                "held_out": [held_out(i) for i in part.column("doc_id").to_pylist()],
                "n_tokens": np.diff(np.append(starts, len(ids))),
                "n_known": np.add.reduceat(found.astype(np.int64), starts),
                "logs": np.add.reduceat(logs, starts),
                "model": np.add.reduceat(each, starts),
                "rest": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rest),
            }
            seen += n
            return out

        return step

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, model double, rest array<struct<word: binary, n: long>>"
    scored = written(map_slices(rows, make, schema, rows=TEXTS), "scored")
    rare = scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n")
    add = rare.join(words, "word").groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"))
    full = scored.drop("rest").join(add, "row", "left").fillna({"more_known": 0, "more": 0.0})
    return full.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more") - F.col("n_tokens") * F.lit(float(np.log10(total + size + 1)))).alias("base_score"),
        (F.col("model") + F.col("more")).alias("score"),
    )
