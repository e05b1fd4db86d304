"""Chat formatting at token level.

A turn is rendered as

    ### Assistant: text</turn>\\n

and never as one string: the role marker and the end marker are reserved ids behind the
vocabulary, and only the escaped text is encoded, by itself. So no text can
produce a marker's id, and an id sequence is read back by cutting it at the reserved ids.

The rendered string is reversible, too: in texts every backslash is doubled, and a
backslash is put before each control string. Reading back drops one backslash before each
backslash or control string. A role that has no marker is written as an escaped text
between two reserved ids.

Each turn is a row with its ids, its loss mask and its place in the conversation. The mask
covers the text of assistant turns: changes of +1 and -1 at their bounds are summed along
the ids. Places are prefix sums over the turns, so a conversation of any length stays many
rows. Reading back takes a conversation's turns in order, one at a time.

Defined results: a null text or role counts as an empty one. Turns come in order of turn, null
first; repeated ones in order of role and text. Null conversation ids are one conversation. Texts may be of any length and
of anything, long runs of blanks too. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import in_arrow, map_batches

#: Reserved ids, counted from the vocabulary's size, and what they render as.
MARKERS = ("### System: ", "### User: ", "### Assistant: ", "### Role ", ": ", "</turn>\n")
ROLES = {"system": 0, "user": 1, "assistant": 2}
OTHER, OTHER_END, END = 3, 4, 5
#: Strings that texts may hold only behind a backslash.
CONTROL = ("### System:", "### User:", "### Assistant:", "### Role", "</turn>")

#: Runs of white space, as the vocabulary's pattern means it, that are encoded by themselves: its matcher keeps a place to go back to for each character.
_LONG = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")

_ESCAPE = re.compile("|".join(re.escape(x) for x in ("\\", *CONTROL)))
_UNESCAPE = re.compile(r"\\(" + "|".join(re.escape(x) for x in ("\\", *CONTROL)) + ")")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


class Template:
    """Encodes and reads back turns. ranks: path of a byte-level vocabulary's rank file."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.coder = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.piece = tiktoken.Encoding("piece", pat_str="(?s:.+)", mergeable_ranks=table, special_tokens={})
        self.first = max(table.values()) + 2  # the id behind the last rank is the vocabulary's own end of text

    def encode(self, text: str) -> list[int]:
        """The library's ids. A long run of white space is one of its pieces, less the last character if something follows."""
        out, at = [], 0
        for m in _LONG.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += self.coder.encode_ordinary(text[at : m.start()])
            out += self.piece.encode_ordinary(text[m.start() : end])
            at = end
        return out + self.coder.encode_ordinary(text[at:])

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a turn and their loss mask."""
        if role in ROLES:
            head = [self.first + ROLES[role]]
        else:
            head = [self.first + OTHER, *self.encode(escape(role)), self.first + OTHER_END]
        body = self.encode(escape(text))
        ids = np.array([*head, *body, self.first + END], dtype=np.int32)
        change = np.zeros(len(ids) + 1, dtype=np.int8)
        if role == "assistant":
            change[len(head)] += 1
            change[len(head) + len(body)] -= 1
        return ids, np.cumsum(change[:-1]).astype(bool)

    def text(self, ids: np.ndarray) -> str:
        """Ids as the rendered string."""
        out, at = [], 0
        for k in np.flatnonzero(ids >= self.first):
            out += [self.coder.decode(ids[at:k].tolist()), MARKERS[ids[k] - self.first]]
            at = k + 1
        return "".join([*out, self.coder.decode(ids[at:].tolist())])

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of a turn's ids."""
        marks = np.flatnonzero(ids >= self.first)
        kind = int(ids[0]) - self.first
        inner = lambda a, b: unescape(self.coder.decode(ids[a + 1 : b].tolist()))
        if kind == OTHER:
            return inner(0, marks[1]), inner(marks[1], marks[2])
        return next(r for r, k in ROLES.items() if k == kind), inner(0, marks[1])

    def masked(self, ids: np.ndarray, mask: np.ndarray) -> str:
        return unescape(self.coder.decode(ids[mask].tolist()))


def format_chats(turns: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """conv_id, turn, nth, start, ids, mask: a row for each turn; start counts the ids before it."""

    def make():
        template = Template(ranks, pattern)

        def step(c: dict) -> dict:
            both = [template.turn(r or "", t or "") for r, t in zip(c["role"], c["text"], strict=True)]
            return {"conv_id": c["conv_id"], "turn": c["turn"], "role": c["role"], "text_order": c["text_order"], "ids": [i for i, _ in both], "mask": [m for _, m in both]}

        return step

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_order"))
    made = map_batches(rows, make, "conv_id long, turn long, role string, text_order string, ids array<int>, mask array<boolean>")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text_order")
    start = F.coalesce(F.sum(F.size("ids")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return made.select("conv_id", "turn", (F.row_number().over(order) - 1).alias("nth"), start.cast("long").alias("start"), "ids", "mask")


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long, loss_ids long"


def read_chats(formatted: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """What the ids hold, conversation by conversation: counts and digests of turns and of text under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(ranks, pattern)
        done: list[tuple] = []
        now = None  # [conversation, turns, digest of turns, characters under the mask, their digest, characters, ids, ids under the mask]

        def close() -> None:
            if now:
                done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), *now[5:]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            names = [x.split()[0] for x in _DIGEST.split(", ")]
            kinds = [pa.string() if "string" in x else pa.int64() for x in _DIGEST.split(", ")]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                conv = batch.column(0)[k].as_py()
                ids = np.array(batch.column(1)[k].values, dtype=np.int64)
                mask = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, text = template.read(ids)
                loss = template.masked(ids, mask)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(template.text(ids))
                now[6] += len(ids)
                now[7] += int(mask.sum())
            if len(done) > 1024:
                yield flush()
        close()
        if done:
            yield flush()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "nth")
    return in_arrow(ordered.select("conv_id", "ids", "mask"), run, _DIGEST)
