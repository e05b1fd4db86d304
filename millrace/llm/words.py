"""Columns of texts as columns of words, by classes of bytes, and the words that tasks hold.

A text's UTF-8 bytes are looked up in a table of 256 classes; runs of WORD bytes are the words.
A whole column is split at once, without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of bytes. A BREAK separates words as a BLANK does, and pieces of a text as well.
WORD, BLANK, BREAK = 0, 1, 2

#: A-Z as a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def classes(blanks: str, breaks: str = "") -> np.ndarray:
    """A table of classes: characters of `blanks` and `breaks`, all below 128, and WORD for all others."""
    out = np.full(256, WORD, dtype=np.uint8)
    out[[ord(c) for c in blanks]] = BLANK
    out[[ord(c) for c in breaks]] = BREAK
    return out


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings or binaries, null as empty, and where each text begins and the last one ends."""
    texts = texts.cast(pa.large_binary())
    starts = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[starts[0] : starts[-1]]
    return data, starts - starts[0]


@dataclass
class Words:
    """The words of a column: distinct ones, each one's place among them, its text, and the piece of all texts that it lies in."""

    distinct: pa.Array
    place: np.ndarray
    text: np.ndarray
    piece: np.ndarray

    def __len__(self) -> int:
        return len(self.place)


def split(texts: pa.Array, table: np.ndarray) -> Words:
    """Words of the texts, lower-cased in A-Z. Pieces end with their text and at BREAK bytes."""
    data, starts = buffer_of(texts)
    raw = data.tobytes()
    kind = np.frombuffer(raw.translate(table.tobytes()), dtype=np.uint8)
    inside = kind == WORD
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = starts[:-1][(starts[:-1] > 0) & (starts[:-1] < len(data))]  # a word ends with its text
    first[heads] = inside[heads]
    last[heads - 1] = inside[heads - 1]
    at = np.flatnonzero(first)
    # words' bytes one behind another, and where each begins there
    packed = raw.translate(LOWER.tobytes()) if len(at) else b""
    packed = np.frombuffer(packed, dtype=np.uint8)[inside[: len(packed)]]
    bounds = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - at, out=bounds[1:])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    coded = column.dictionary_encode()
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, starts)))
    # texts and breaks are numbered together, so a piece's number is its text's plus the breaks so far
    broken = kind == BREAK
    marks = first[first | broken]
    return Words(coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64), text, text + np.cumsum(~marks)[marks])


def sums_by(keys: np.ndarray, *amounts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each of the amounts over them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[at], *(np.add.reduceat(x[order], at) if len(at) else x[:0] for x in amounts)


def merged_tables(found: list[pa.Table], by: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The tables' other columns summed by `by`, in the tables' order of columns."""
    if not found:
        return
    names = found[0].column_names
    amounts = [n for n in names if n not in by]
    summed = pa.concat_tables(found).group_by(by, use_threads=False).aggregate([(n, "sum") for n in amounts])
    yield from pa.table({n: summed[n if n in by else f"{n}_sum"] for n in names}).to_batches(max_chunksize=rows)


def heaviest(rows: DataFrame, amount: str, most: int) -> DataFrame:
    """The rows of the largest amounts (whole numbers from 0), `most` at most; all rows of about one amount are in or out together.

    Amounts are counted by band: up to 2047 each is one, larger ones are told apart by their first 11 bits, so
    there are 120,000 bands at most. If more than `most` rows share the largest band, there are none.
    """
    shift = f"int(greatest(length(bin({amount})) - 11, 0))"
    band = F.expr(f"int(shiftright({amount}, {shift}) + {shift} * 2048)")
    held, least = 0, None
    for r in rows.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():
        if held + r["count"] > most:
            break
        held, least = held + r["count"], r["band"]
    return rows.where(F.lit(False)) if least is None else rows.where(band >= least)
