"""Packing documents into sequences of bounded length by a linear grouping scheme.

Documents become token ids, and only longer ones than a sequence are cut. Pieces of equal
length are interchangeable, so the plan needs nothing but the number of pieces of each
length, at most `capacity` numbers whatever the size of the table:

1. Large lengths are put in descending order and dealt into groups of equal cardinality;
   each length counts as the largest of its group.
2. A linear program over configurations of these few sizes is solved by column
   generation: a knapsack finds the configuration that the current prices favour most.
3. Whole multiples of the configurations are opened, and their places are filled with the
   actual lengths of the groups, which leaves some room.
4. What is left of the large ones, then the small ones, go by best fit, longest first:
   each into the fullest sequence that has room. Sequences with equal room are handled as
   one run, so the work grows with the number of lengths, not of pieces.

A piece's place follows from its length and its rank among pieces of that length. Ranks
are counted in each task and shifted by the counts of the tasks before.

Defined results: a null text is empty and is one piece, the end id alone. Rows repeated
under one id are each packed. An empty table gives an empty result. Texts of any length are
cut, never shortened. Other columns are not looked at.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import held, map_batches, map_slices, written
from millrace.llm.word_ids import WordIds

#: Texts, and bytes of them, that are split into words at a time: more are quicker, fewer take less memory.
TEXTS, TEXT_BYTES = 2048, 2 << 20

#: A run of `count` sequences from number `start`: (start, count).
#: A placement: length, first rank, pieces in each sequence, first sequence, sequences, offset.
Placement = tuple[int, int, int, int, int, int]


def _best_configuration(sizes: Sequence[int], prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: numbers of each size that fit and are worth most."""
    value = np.zeros(capacity + 1)
    stages = [value]
    for size, price in zip(sizes, prices, strict=True):
        value = value.copy()
        many = 1
        while price > 0 and many * size <= capacity:  # 1, 2, 4 ... more of this size
            room = many * size
            value[room:] = np.maximum(value[room:], value[: capacity + 1 - room] + many * price)
            many *= 2
        stages.append(value)
    counts = np.zeros(len(sizes))
    room = capacity
    for k in range(len(sizes) - 1, -1, -1):
        while stages[k + 1][room] > stages[k][room] + 1e-12:
            counts[k] += 1
            room -= sizes[k]
    return float(counts @ prices), counts


def configurations(sizes: Sequence[int], demand: Sequence[int], capacity: int, rounds: int = 300) -> list[tuple[np.ndarray, float]]:
    """Configurations of a few sizes and how often each is used, from the linear relaxation."""
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.asarray(demand, dtype=float)
    amount = np.linalg.solve(basis, need)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, column = _best_configuration(sizes, np.maximum(prices, 0), capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        amount = np.maximum(np.linalg.solve(basis, need), 0)
    return [(basis[:, k], float(amount[k])) for k in range(len(sizes))]


class _Queue:
    """The pieces of a group, longest first: runs [length, first rank, count]."""

    def __init__(self):
        self.runs: list[list[int]] = []
        self.left = 0

    def add(self, length: int, first: int, count: int) -> None:
        self.runs.append([length, first, count])
        self.left += count

    def take(self, most: int) -> tuple[int, int, int]:
        length, first, count = run = self.runs[0]
        n = min(count, most)
        if n == count:
            self.runs.pop(0)
        else:
            run[1], run[2] = first + n, count - n
        self.left -= n
        return length, first, n


def _grouped(counts: dict[int, int], least: int, groups: int) -> tuple[list[int], list[_Queue]]:
    """Large lengths in groups of equal cardinality; groups rounded up to one size are one."""
    total = sum(n for length, n in counts.items() if length >= least)
    each = max(1, -(-total // groups))
    sizes: list[int] = []
    queues: list[_Queue] = []
    filled = each
    for length in sorted((x for x in counts if x >= least), reverse=True):
        at, left = 0, counts[length]
        while left:
            if filled >= each:
                filled = 0
                if not sizes or sizes[-1] != length:
                    sizes.append(length)
                    queues.append(_Queue())
            n = min(left, each - filled)
            queues[-1].add(length, at, n)
            at, left, filled = at + n, left - n, filled + n
    return sizes, queues


def plan(counts: dict[int, int], capacity: int, groups: int = 96, small: float = 1 / 3) -> tuple[int, list[Placement]]:
    """Number of sequences and the placements of all pieces. counts: pieces of each length."""
    least = max(1, int(capacity * small) + 1)
    sizes, queues = _grouped(counts, least, groups)
    placed: list[Placement] = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    n = 0
    for config, amount in configurations(sizes, [q.left for q in queues], capacity) if sizes else []:
        used = [(k, int(c)) for k, c in enumerate(config) if c]
        many = min([int(amount + 1e-6), *(queues[k].left // c for k, c in used)])
        if many <= 0:
            continue
        runs = [(n, many, 0)]  # first sequence, sequences, filled so far
        n += many
        for k in (k for k, c in used for _ in range(c)):
            after = []
            for start, count, filled in runs:
                while count:
                    length, first, m = queues[k].take(count)
                    placed.append((length, first, 1, start, m, filled))
                    after.append((start, m, filled + length))
                    start, count = start + m, count - m
            runs = after
        for start, count, filled in runs:
            rooms[capacity - filled].append((start, count))

    rest = [run for q in queues for run in q.runs] + [[x, 0, c] for x, c in sorted(counts.items(), reverse=True) if x < least]
    order = sorted(r for r in rooms if r)  # amounts of room that some sequence has

    def put(room: int, start: int, count: int) -> None:
        if room and count:
            if not rooms[room]:
                bisect.insort(order, room)
            rooms[room].append((start, count))

    for r in [r for r in order if not rooms[r]]:
        order.remove(r)
    for length, first, left in sorted(rest, key=lambda x: -x[0]):
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                many = max(1, left // (capacity // length))
                put(capacity, n, many)
                n += many
                continue
            room = order[at]
            start, count = rooms[room].pop()
            if not rooms[room]:
                order.pop(at)
            each = min(room // length, left)
            use = min(count, left // each)
            placed.append((length, first, each, start, use, capacity - room))
            first, left = first + each * use, left - each * use
            put(room - each * length, start, use)
            put(room, start + use, count - use)
    return n, placed


def best_plan(counts: dict[int, int], capacity: int, tries: Sequence[tuple[int, float]] = ((64, 1 / 2), (96, 2 / 5), (96, 1 / 3), (48, 1 / 4))) -> tuple[int, list[Placement]]:
    """The plan with fewest sequences over several numbers of groups and limits for small ones."""
    least = -(-sum(x * c for x, c in counts.items()) // capacity)
    best = None
    for groups, small in tries:
        found = plan(counts, capacity, groups, small)
        if best is None or found[0] < best[0]:
            best = found
        if best[0] == least:
            break
    return best


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each piece of each document, with the task that made it and its rank there among equal lengths."""

    def make():
        words = held(("word ids", tokenizer), lambda: WordIds(tokenizer))
        seen = np.zeros(capacity + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        last = np.array([end], dtype="<u4").tobytes()

        def step(c: pa.RecordBatch) -> dict:
            out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank")}
            for i, ids in zip(c.column("doc_id").to_pylist(), words.encode(c.column("text")), strict=True):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    n = len(piece) // 4
                    for name, x in zip(out, (i, k, at // 4, n, zlib.crc32(piece), part, seen[n]), strict=True):
                        out[name].append(x)
                    seen[n] += 1
            return out

        return step

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_slices(rows, make, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long", rows=TEXTS, most=TEXT_BYTES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    made = written(pieces(docs, tokenizer, capacity, end, text, key), "pieces")
    parts = written(made.groupBy("part", "length").agg(F.count("*").alias("n")), "parts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    by_length: dict[int, list[Placement]] = defaultdict(list)
    for p in best_plan(counts, capacity)[1] if counts else []:
        by_length[p[0]].append(p)
    table = {length: np.array(sorted(p, key=lambda x: x[1]), dtype=np.int64) for length, p in by_length.items()}

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = made.join(shift, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def make():
        def step(c: dict) -> dict:
            length, rank = np.array(c["length"]), np.array(c.pop("rank"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length):
                own = length == x
                rows = table[int(x)]
                p = rows[np.searchsorted(rows[:, 1], rank[own], side="right") - 1]
                nth = rank[own] - p[:, 1]
                sequence[own] = p[:, 3] + nth // p[:, 2]
                offset[own] = p[:, 5] + nth % p[:, 2] * x
            return c | {"sequence_id": sequence, "offset": offset}

        return step

    return map_batches(ranked, make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
