"""Ids of texts under a word-level BPE tokenizer that drops white space, as its library gives them.

White space and changes between letters and punctuation separate parts whose ids don't depend on
each other. A column of texts is split into its distinct parts by Arrow, each is looked up once, and
the ids of all texts are gathered from one array. Parts that aren't remembered are encoded by the
library: a run of Latin letters, which its normaliser and splitting leave whole, by its merges
alone, others many in one call with its end token between them. Parts that occur again are
remembered, a bounded number of bounded length.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm.common import KEPT

#: Characters under this one are alike after canonical composition, whatever stands beside them.
_PLAIN = "ɐ"

#: Characters that compose with letters of ASCII; texts that hold one are not lower-cased beforehand.
_MARKS = "[̀-ͯ]"

#: A letter under U+0250 or a digit, and punctuation behind it: a blank between them changes nothing. U+0130 is left out, as its lower case ends with a mark.
_EDGE = "([a-z0-9ß-öø-įı-ɏ])([!-/:-@\\[-`{-~])"

#: Parts whose ids are gathered at a time.
PARTS = 1 << 18


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """memo: parts that are remembered; all are forgotten once there are so many."""

    def __init__(self, tokenizer: str, memo: int = 150_000):
        from tokenizers import Tokenizer

        letters = _byte_letters()
        self.bytes = {ord(c): "".join(map(letters.__getitem__, c.encode())) for c in map(chr, range(128, ord(_PLAIN)))}
        self.library = Tokenizer.from_file(tokenizer)
        self.merges = self.library.model.tokenize
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.between = self.special[-1]
        self.between_id = self.library.token_to_id(self.between)
        self.memo = memo
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _many(self, parts: list[str]) -> list[bytes]:
        """Ids of parts by the library. None of them holds a special token's string."""
        found = []
        for at in range(0, len(parts), 1000):
            some = parts[at : at + 1000]
            ids = np.array(self.library.encode(self.between.join(some), add_special_tokens=False).ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.between_id), len(ids)).tolist()
            found += [ids[a:b].tobytes() for a, b in zip([0, *(e + 1 for e in ends)], ends, strict=False)]
        return found

    def _encoded(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of each part."""
        found, rest, merges = {}, [], self.merges
        for part in parts:
            if part.isalpha():
                low = part.lower()
                if not low.isascii():
                    if max(part) >= _PLAIN or max(low) >= _PLAIN or len(low) != len(part):
                        rest.append(part)
                        continue
                    low = low.translate(self.bytes)
                found[part] = array("I", [t.id for t in merges(low)]).tobytes()
            elif part:
                rest.append(part)
            else:
                found[part] = b""
        found.update(zip(rest, self._many(rest), strict=True))
        return found

    def _ids(self, distinct: list[str], times: np.ndarray) -> list[bytes]:
        """Ids of each distinct part, and remember those that come again."""
        known = self.known
        new = [p for p in distinct if p not in known]
        found = self._encoded(new)
        out = [known[p] if p in known else found[p] for p in distinct]
        again = [p for p, n in zip(distinct, times.tolist(), strict=True) if n > 1 and p in found and len(p) <= KEPT]
        if len(known) + len(again) > self.memo:
            known.clear()
        known.update((p, found[p]) for p in again[: self.memo])
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens added."""
        texts = pc.fill_null(texts, "")
        # a text that may hold a special token's string, in either case, goes to the library whole
        whole = np.zeros(len(texts), dtype=bool)
        for s in {s[:2] for s in self.special}:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        apart = {int(k): self._whole(texts[int(k)].as_py()) for k in np.flatnonzero(whole)}
        if apart:
            texts = pc.if_else(pa.array(whole), "", texts)
        texts = pc.if_else(pc.match_substring_regex(texts, _MARKS), texts, pc.ascii_lower(texts))
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _EDGE, "\\1 \\2"))
        distinct = parts.flatten().dictionary_encode()
        place = distinct.indices.to_numpy()
        ids = self._ids(distinct.dictionary.to_pylist(), np.bincount(place, minlength=len(distinct.dictionary)))
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 2
        start = np.concatenate([[0], np.cumsum(size)])
        ids, ends = np.frombuffer(b"".join(ids), dtype="<u4"), np.concatenate([[0], np.cumsum(size[place])])
        found = np.empty(ends[-1], dtype="<u4")
        for at in range(0, len(place), PARTS):  # an id's place among those of the distinct parts, from its place in the texts
            some, a, b = place[at : at + PARTS], ends[at], ends[min(at + PARTS, len(place))]
            found[a:b] = ids[np.repeat(start[some] - ends[at : at + len(some)], size[some]) + np.arange(a, b)]
        found = memoryview(found).cast("B")
        cuts = (4 * ends[parts.offsets.to_numpy()]).tolist()
        return [apart[k] if k in apart else bytes(found[cuts[k] : cuts[k + 1]]) for k in range(len(texts))]
