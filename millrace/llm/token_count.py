"""Token counts under a byte-level BPE tokenizer, without ids.

A text is cut into chunks that the tokenizer's own splitting can't cross: a run of
characters other than white space with the space before it, or a run of white space. The
count of a chunk is remembered, as most chunks recur. A new one is split by the
library's pre-tokenizer, and each piece is merged here: its symbols form a linked
list, a heap holds the ranks of adjacent pairs, and the lowest-ranked pair is popped and
merged until no pair has a rank. The count is the initial symbols minus the merges. That
takes n log n steps for a piece of n bytes, so a long piece costs little more a byte.

Strings of special tokens inside a text are one token each, as the library treats them by default.

Defined results: a null or empty text has 0 bytes and 0 tokens. Rows repeated under one id
are each counted. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Recent, held, map_batches

#: White space as Unicode has it, which the tokenizer's pattern means by its blank class.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def merges_left(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols that remain once adjacent pairs have been merged, lowest rank first, leftmost of equals."""
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    heap = [(r, k) for k in range(n - 1) if (r := ranks.get((symbols[k], symbols[k + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        rank, k = heapq.heappop(heap)
        right = after[k]
        # an entry is stale once either symbol has changed or gone
        if symbols[k] is None or right < 0 or ranks.get((symbols[k], symbols[right])) != rank:
            continue
        symbols[k] += symbols[right]
        symbols[right] = None
        left -= 1
        after[k] = end = after[right]
        if end >= 0:
            before[end] = k
            if (r := ranks.get((symbols[k], symbols[end]))) is not None:
                heapq.heappush(heap, (r, k))
        start = before[k]
        if start >= 0 and (r := ranks.get((symbols[start], symbols[k]))) is not None:
            heapq.heappush(heap, (r, start))
    return left


class TokenCounter:
    def __init__(self, tokenizer: str, memo: int = 300_000):
        from tokenizers import Tokenizer

        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"])
        self.ranks = {pair: k for k, pair in enumerate(pairs)}
        self.split = Tokenizer.from_file(tokenizer).pre_tokenizer.pre_tokenize_str
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        self.chunks = Recent(self._chunk, memo)

    def _chunk(self, chunk: str) -> int:
        return sum(merges_left(list(symbols), self.ranks) for symbols, _ in self.split(chunk))

    def _plain(self, text: str) -> int:
        return sum(map(self.chunks.__getitem__, _CHUNK.findall(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than limit)."""

    def make():
        counter = held(("token counts", tokenizer), lambda: TokenCounter(tokenizer))

        def step(c: dict) -> dict:
            counts = [counter.count(t) for t in c["text"]]
            return {"doc_id": c["doc_id"], "n_bytes": [len((t or "").encode()) for t in c["text"]], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

        return step

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
