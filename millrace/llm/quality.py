"""Quality classifier from weak labels.

1. Labellers: heuristics that look at one property of a text each, and vote bad (0), good (1) or
   abstain (2). They overlap and err.
2. Label model: documents are counted by their votes, at most 3 ** labellers numbers, and
   expectation-maximisation finds the share of good documents and each
   labeller's accuracy on good and on bad ones; abstaining says nothing. It gives each
   pattern of votes a posterior.
3. Scorer: a logistic model over hashed word features, trained on the posteriors of
   a sample of at most `sample` documents, the first ones in order of a hash of the
   id. Counting votes, the label model and scoring cover all documents.

A document is kept if its score is at least `least`, which lies low, so that what is rejected is clear.

Defined results: null, empty and blank texts get the votes of an empty text and a score
from the bias alone; they are rejected, having nothing to train on. Rows repeated under one
id are each scored, alike. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Recent, in_arrow, map_batches, slices

BAD, GOOD, ABSTAIN = 0, 1, 2

#: Frequent function words of the languages at hand. Texts that are mostly in another script aren't held against them.
FUNCTION_WORDS = frozenset(
    b"the of and to in a is that it for on was be with as this by at are or from an not "
    b"der die und das den von zu mit ist des im ein eine nicht auf sich dem als auch "
    b"de la le les et des en un une du que est dans qui par pour sur au plus "
    b"el los las y que una por con para es su del se al lo no como".split()
)
_SYMBOLS = b"#$%&*|~^_={}<>[]\\!"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower()
_ASCII = bytes(range(128))
_TAIL = re.compile(rb"[^\w\s\x80-\xff]{2,}(?=\s|$)")


def _bands(value: float, good: float, bad: float) -> int:
    """Good up to one bound, bad from the other; the bounds may lie either way."""
    if good <= bad:
        return GOOD if value <= good else BAD if value >= bad else ABSTAIN
    return GOOD if value >= good else BAD if value <= bad else ABSTAIN


class Facts:
    """A text's bytes and words, and the shares of words that repeat the last one and of distinct words."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode()
        self.words = self.raw.split()
        n = max(1, len(self.words))
        self.again, self.distinct = sum(map(eq, self.words, self.words[1:])) / n, len(set(self.words)) / n


def _votes(text: Facts) -> list[int]:
    raw, n = text.raw, len(text.words)
    if not n:
        return [BAD] * len(LABELLERS)
    letters = max(1, len(raw) - len(raw.translate(None, _LETTERS)))
    symbols = (len(raw) - len(raw.translate(None, _SYMBOLS))) / len(raw)
    upper = (len(raw) - len(raw.translate(None, _UPPER))) / letters
    foreign = 2 * len(raw.translate(None, _ASCII)) > len(raw)  # a script that none of the listed words is written in
    function = sum(map(FUNCTION_WORDS.__contains__, raw.lower().split())) / n
    tails = len(_TAIL.findall(raw)) / n
    return [
        _bands(symbols, 0.008, 0.03),
        _bands(upper, 0.12, 0.35),
        _bands(text.again, 0.02, 0.15),
        _bands(function, 0.10, 0.03) if n >= 20 and not foreign else ABSTAIN,
        _bands(tails, 0.02, 0.10),
        _bands(text.distinct, 0.35, 0.12) if n >= 50 else ABSTAIN,
        _bands(len(raw) / n, 8.0, 10.0) if n >= 20 else ABSTAIN,
    ]


def votes(text: str | None) -> list[int]:
    return _votes(Facts(text))


LABELLERS = ("symbols", "capitals", "repeated words", "function words", "symbols behind words", "distinct words", "long words")


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, dict]:
    """Posterior of good for each pattern of votes, and the model. counts: documents with that pattern."""
    weight = counts.astype(float)
    n, labellers = patterns.shape
    # a fault that two labellers see is where the bad class starts from
    posterior = np.choose(np.minimum((patterns == BAD).sum(axis=1), 2), [0.9, 0.5, 0.1])
    share, right = 0.5, None
    for _ in range(rounds):
        share = float((weight * posterior).sum() / weight.sum())
        held = np.stack([1 - posterior, posterior]) * weight  # class, pattern
        cast = np.stack([held @ (patterns == v) for v in (BAD, GOOD)], axis=2) + 0.5  # class, labeller, vote
        chance = cast / cast.sum(axis=2, keepdims=True)
        log = np.concatenate([np.log(chance), np.zeros((2, labellers, 1))], axis=2)  # to abstain says nothing
        like = log[:, np.arange(labellers)[None, :], patterns].sum(axis=2)
        odds = like[GOOD] - like[BAD] + np.log(max(share, 1e-9)) - np.log(max(1 - share, 1e-9))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - posterior).max() < 1e-9
        posterior = new
        right = (cast[BAD, :, BAD] + cast[GOOD, :, GOOD]) / cast.sum(axis=(0, 2))
        if done:
            break
    return posterior, {"share": share, "accuracy": dict(zip(LABELLERS, right.round(4).tolist(), strict=False)), "chance": chance}


#: Hashed features of the scorer.
WIDTH = 1 << 14
_MARKS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"([Aa0])\1+")


def word_names(word: bytes) -> list[bytes]:
    """Shape (runs of capitals, other letters and digits as one mark each), ending, length and, of a short word, the word itself."""
    end = b"end " + word[-3:] if not word[-1:].isalnum() and word[-1] < 128 else b"end"
    names = [b"shape " + _RUN.sub(rb"\1", word.translate(_MARKS)), end, b"length %d" % min(len(word), 20)]
    if len(word) <= 5:
        names.append(b"word " + word.lower())
    return names


def feature(name: bytes) -> int:
    return xxhash.xxh32_intdigest(name) % WIDTH


def word_features(word: bytes) -> list[int]:
    return list(map(feature, word_names(word)))


_AGAIN, _SAME = feature(b"again"), feature(b"same")


def _extra(text: Facts) -> tuple[float, float]:
    """Shares of words that repeat the last one, and of words that are no new ones."""
    return text.again, max(0.0, 1 - text.distinct - 0.5)


def document_features(text: str | None, memo: dict | None = None) -> dict[int, float]:
    facts = Facts(text)
    words = facts.words
    memo = Recent(word_features, 1000) if memo is None else memo
    out: dict[int, float] = {}
    for w in words:
        for f in memo[w]:
            out[f] = out.get(f, 0.0) + 1 / len(words)
    if words:
        for f, x in zip((_AGAIN, _SAME), _extra(facts), strict=True):
            out[f] = out.get(f, 0.0) + x
    return out


def fit_scorer(features: list[dict[int, float]], target: np.ndarray, epochs: int = 10, rate: float = 0.5, shrink: float = 1e-5, seed: int = 1) -> tuple[np.ndarray, float]:
    """Logistic weights and bias on soft targets, by adaptive gradient steps on single documents."""
    weights, bias = np.zeros(WIDTH), 0.0
    squares, square = np.full(WIDTH, 1e-6), 1e-6
    rows = [(np.fromiter(x, dtype=np.int64), np.fromiter(x.values(), dtype=float)) for x in features]
    draw = np.random.default_rng(seed)
    for _ in range(epochs if rows else 0):
        for k in draw.permutation(len(rows)):
            f, x = rows[k]
            p = 1 / (1 + np.exp(-np.clip(weights[f] @ x + bias, -40, 40)))
            step = (p - target[k]) * x + shrink * weights[f]
            squares[f] += step**2
            weights[f] -= rate * step / np.sqrt(squares[f])
            square += (p - target[k]) ** 2
            bias -= rate * (p - target[k]) / np.sqrt(square)
    return weights, bias


class Scorer:
    """Scores texts with fitted weights. A word's share of the score is remembered, and so are those of shapes and endings, which recur in new words."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.parts = Recent(lambda name: float(weights[feature(name)]), 50_000)
        self.worth = Recent(lambda w: sum(map(self.parts.__getitem__, word_names(w))), 100_000)

    def of(self, text: Facts) -> float:
        if not text.words:
            return 0.0
        again, same = _extra(text)
        z = self.bias + sum(map(self.worth.__getitem__, text.words)) / len(text.words) + again * self.weights[_AGAIN] + same * self.weights[_SAME]
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, float(z)))))

    def __call__(self, text: str | None) -> float:
        return self.of(Facts(text))


def _code(text: Facts) -> int:
    return sum(v * 3**k for k, v in enumerate(_votes(text)))


def code_of(text: str | None) -> int:
    return _code(Facts(text))


def fit(docs: DataFrame, sample: int = 6000, text: str = "text", key: str = "doc_id") -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors by code of votes, weights and bias."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = len(LABELLERS)

    def cast():
        return lambda c: {"votes": [code_of(t) for t in c["text"]]}

    counted = map_batches(rows.select("text"), cast, "votes int").groupBy("votes").count().orderBy("votes").toPandas()  # 3 ** labellers rows at most
    codes = counted["votes"].to_numpy(dtype=np.int64)
    total = int(counted["count"].sum())
    by_code = np.zeros(3**n)
    if not total:
        return by_code, np.zeros(WIDTH), 0.0
    by_code[codes] = fit_labels(codes[:, None] // 3 ** np.arange(n) % 3, counted["count"].to_numpy())[0]

    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    some = rows.where(F.col("doc_id").isNotNull())
    if total > sample:  # a margin, and the exact bound behind it
        some = some.where(order < F.lit(int((1 << 30) * min(1.0, 1.1 * sample / total))))

    def learn():
        memo = Recent(word_features, 50_000)

        def step(c: dict) -> dict:
            found = [document_features(t, memo) for t in c["text"]]
            return {"doc_id": c["doc_id"], "votes": [code_of(t) for t in c["text"]], "f": [list(x) for x in found], "x": [list(x.values()) for x in found]}

        return step

    taken = map_batches(some, learn, "doc_id long, votes int, f array<int>, x array<float>")
    taken = taken.orderBy(order, "doc_id").limit(sample).toPandas()
    features = [dict(zip(f, x, strict=True)) for f, x in zip(taken["f"], taken["x"], strict=True)]
    return by_code, *fit_scorer(features, by_code[taken["votes"].to_numpy(dtype=np.int64)])


def classify(docs: DataFrame, sample: int = 6000, least: float = 0.3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, votes (a digit of base 3 for each labeller), posterior, score, kept."""
    by_code, weights, bias = fit(docs, sample, text, key)

    def make():
        scorer = Scorer(weights, bias)

        def step(c: dict) -> dict:
            facts = list(map(Facts, c["text"]))
            scores, codes = list(map(scorer.of, facts)), list(map(_code, facts))
            return {"doc_id": c["doc_id"], "votes": codes, "posterior": by_code[codes], "score": scores, "kept": [s >= least for s in scores]}

        return step

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, make, "doc_id long, votes int, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, sample: int = 6000, least: float = 0.3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns; no join is needed."""
    _, weights, bias = fit(docs, sample, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, bias)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([scorer(t) >= least for t in part.column(place).to_pylist()], type=pa.bool_()))

    place = docs.columns.index(text)
    return in_arrow(docs, run, docs.schema)
