import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import maxent
from millrace.llm.maxent import FAN, FEATURES, KINDS, ROWS, Coder, Trainer, Tree, coded, contexts, held_out, kinds, log_chances, mixed, rows_of, score_texts, tokens


def kind(token):
    """How a token looks, a second way."""
    last = token[-1:]
    end = 1 if last == b"." else 2 if last == b"," else 3 if last and last[0] < 128 and not last.isalpha() else 0
    marks = next((k for k, m in enumerate(("äöüß", "éèêçàùâîôû", "ñóíáú¿¡"), 1) if set(token.decode()) & set(m)), 0)
    return marks * 4 + end


def base(rows):
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(w := tokens(t)), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t in rows]


@pytest.mark.parametrize("known", [1 << 17, 20])
def test_base_against_brute_force(docs, known, monkeypatch):
    """With few known counts most tokens take the way over the join."""
    monkeypatch.setattr(maxent, "KNOWN", known)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    n, want = base(rows)
    found = score_texts(docs).collect()
    assert {r["train_tokens"] for r in found} == {n}
    assert sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in found], key=str) == sorted(want, key=str)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = score_texts(docs).where("held_out").toPandas()
    n = found["n_tokens"].sum()
    assert found["score"].sum() / n > found["base_score"].sum() / n + 0.2


@pytest.mark.parametrize("outcomes", [16, 31, 4096 - 4096 % 15 + 1, 65536])
def test_chances_of_outcomes_sum_to_one(outcomes):
    rng = np.random.default_rng(1)
    tree = Tree(rng.zipf(1.3, outcomes).clip(1, 10**9))
    weights = rng.normal(size=(maxent.n_rows(outcomes), FAN)).astype(np.float32)
    context = np.tile(rng.integers(0, outcomes, (FEATURES, 1)).astype(np.uint64), (1, outcomes))
    assert abs((10 ** log_chances(weights, np.arange(outcomes), context, tree)).sum() - 1) < 1e-4


def test_tree_is_full_and_frequent_outcomes_have_short_ways():
    rng = np.random.default_rng(1)
    frequency = rng.zipf(1.2, 1 + 15 * 40).clip(1, 10**9)
    tree = Tree(frequency)
    assert sum(FAN ** -int(d) for d in tree.depth) == 1
    order = np.argsort(frequency)
    assert (np.diff(tree.depth[order].astype(int)[np.unique(frequency[order], return_index=True)[1]]) <= 0).all()
    ways = {tuple((int(tree.nodes[k, i]), int(tree.branches[k, i])) for k in range(tree.depth[i])) for i in range(len(tree))}
    assert len(ways) == len(tree) and all(w[0][0] == 0 for w in ways)


def test_contexts_stay_in_their_text():
    start = 4111
    ids = np.array([5, 6, 7, 8, 9])
    c = contexts(ids, np.array([0, 3]), start)
    assert c[0].tolist() == [start, 5, 6, start, 8] and c[1].tolist() == [start, start, 5, start, start]
    assert c[2].tolist() == [a * (start + 1) + b for a, b in zip(c[0].tolist(), c[1].tolist(), strict=True)]


def test_training_step_lowers_the_loss():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 40, 4000)
    ids[1::2] = (ids[::2] * 3 + 1) % 40
    tree = Tree([1] * 46)
    context = contexts(ids, np.array([0]), len(tree))
    trainer = Trainer(np.zeros((ROWS, FAN), dtype=np.float32), 0.3, tree)
    before = log_chances(trainer.weights, ids, context, tree).mean()
    for _ in range(20):
        trainer.step(ids, context)
    assert log_chances(trainer.weights, ids, context, tree).mean() > before + 1.2


def test_sums_by_row():
    rng = np.random.default_rng(5)
    rows = rng.zipf(1.3, (FEATURES, 900)).clip(1, 5000).astype(np.uint64)
    error = rng.normal(size=(900, FAN)).astype(np.float32)
    want = defaultdict(lambda: np.zeros(FAN))
    for f in range(FEATURES):
        for t in range(900):
            want[int(rows[f, t])] += error[t]
    used, sums = maxent._sums(rows, error)
    assert sorted(used.tolist()) == sorted(want)
    assert all(np.allclose(x, want[r], atol=1e-3) for r, x in zip(used.tolist(), sums, strict=True))


def test_kinds_and_codes():
    words = [b"", b"ab.", "für,".encode(), b"x#", "é".encode(), "ñéü9".encode(), "¿qué?".encode(), "漢".encode(), b"-", b".a", "á,".encode()]
    assert kinds(pa.array(words)).tolist() == [kind(w) for w in words] and kinds(pa.array(words).slice(2, 5)).tolist() == [kind(w) for w in words[2:7]]
    assert kind(b"") == 0 and kind(b"ab.") == 1 and kind("für,".encode()) == 6 and kind(b"x#") == 3
    assert kinds(pa.array([], pa.binary())).tolist() == []
    ids, rank = Coder([b"the", b"of", b"y."], 2)(pa.array([b"the", b"x.", b"y."]))
    assert ids.tolist() == [16, 1, 1] and rank.tolist() == [0, -1, 2]


def test_columns_of_texts_have_the_tokens_of_each(docs):
    texts = [r["text"] for r in docs.collect()] + ["\x1c a\x0b\x0cB É\x85c ", "", "\u2028"]
    distinct, places, starts = coded(pa.array(texts, pa.string()))
    words = [distinct[int(k)].as_py() for k in places]
    assert [words[a:b] for a, b in zip(starts, [*starts[1:], len(words)], strict=True)] == [tokens(t) for t in texts]
    assert coded(pa.array([None], pa.string()))[1].tolist() == [0]


def plain_model(rows, rounds, rate):
    """Log10 probability of each text by the same model, in plain loops. One task."""
    train = Counter(w for i, t in rows if not held_out(i) for w in tokens(t))
    known = sorted(train, key=lambda w: (-train[w], w))
    leaves = len(known) // 15 * 15
    outcome = {w: KINDS + k for k, w in enumerate(known[:leaves])}
    mass = defaultdict(lambda: [0, 0])
    for w in known[leaves:]:
        mass[kind(w)][0] += train[w]
        mass[kind(w)][1] += 1
    tree = Tree([*(mass[k][0] + 1 for k in range(KINDS)), *(train[w] for w in known[:leaves])], [*[b""] * KINDS, *known[:leaves]])
    weights, start = defaultdict(lambda: np.zeros(FAN)), len(tree)

    def ways(texts):
        """For each token: level by level, the rows of its features and its branch."""
        for t in texts:
            ids = [outcome.get(w, kind(w)) for w in tokens(t)]
            for n, x in enumerate(ids):
                a, b, c = (ids[n - k] if n >= k else start for k in (1, 2, 3))
                context = np.array([[a], [b], [a * (start + 1) + b], [c], [0]], dtype=np.uint64)
                yield [(rows_of(mixed(context), np.array([tree.nodes[d, x]], dtype=np.uint16))[:, 0].tolist(), int(tree.branches[d, x])) for d in range(tree.depth[x])]

    def chances(at):
        z = np.exp(sum(weights[r] for r in at))
        return z / z.sum()

    for number in range(rounds):
        squares = defaultdict(lambda: 1.0)
        mine = [t for i, t in rows if not held_out(i) and zlib.crc32(f"round {'' if i is None else i}".encode()) % rounds == number]
        found = list(ways(mine))
        for at in range(0, len(found), maxent.STEP):
            step = found[at : at + maxent.STEP]
            for level in range(max(map(len, step))):
                gradient = defaultdict(lambda: np.zeros(FAN))
                for way in step:
                    if len(way) > level:
                        error = chances(way[level][0])
                        error[way[level][1]] -= 1
                        for r in way[level][0]:
                            gradient[r] += error
                for r, g in gradient.items():
                    squares[r] += (g @ g) / FAN
                    weights[r] = weights[r] - rate * g / math.sqrt(squares[r])
    out = []
    for _, t in rows:
        total = sum(math.log10(chances(at)[branch]) for way in ways([t]) for at, branch in way)
        rest = [w for w in tokens(t) if w not in outcome]
        out.append(total + sum(math.log10((train[w] + 1) / (sum(mass[kind(w)]) + 1)) for w in rest))
    return out


def test_score_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(maxent, "STEP", 64)
    words = "the of and a to in is it on at by we he she they one two red blue old new sun sea sky.".split()
    texts = [" ".join(words[(k * k * j + k + j) % len(words)] for j in range(1 + k % 17)) for k in range(60)] + ["", None]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r["score"] for r in score_texts(docs).collect()}
    want = plain_model(rows, 2, 0.3)
    assert np.allclose([found[i] for i, _ in rows], want, rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("known", [10, 31, 100, 5000])
def test_bound_on_known_words_holds(spark, known, monkeypatch):
    """Also where more words than that share the largest count."""
    monkeypatch.setattr(maxent, "KNOWN", known)
    counts = [(b"w%d" % k, 70000 if k < 30 else 4000 - k) for k in range(3000)]
    found = [(bytes(r["word"]), r["c"]) for r in maxent._top(spark.createDataFrame(counts, "word binary, c long")).collect()]
    assert len(set(found)) == len(found) <= known and set(found) <= set(counts)
    assert known < 30 or known > 3000 or min(c for _, c in found) >= max([0, *(c for w, c in counts if (w, c) not in set(found))])
    assert len(found) >= min(known, 3000) - 2


def test_empty_table(none):
    assert score_texts(none).count() == 0


def test_model_has_a_bias_and_the_third_last_token():
    c = contexts(np.array([5, 6, 7, 8, 9]), np.array([0, 4]), 99)
    assert len(c) == FEATURES == 5
    assert c[3].tolist() == [99, 99, 99, 5, 99] and len(set(c[4].tolist())) == 1


def test_rows_grow_with_the_vocabulary():
    assert maxent.n_rows(100) == ROWS and maxent.n_rows(1_000_000) == maxent.MOST_ROWS > ROWS
    rng = np.random.default_rng(2)
    context = rng.integers(0, 10**9, (FEATURES, 5000)).astype(np.uint64)
    flat = rows_of(mixed(context), np.arange(5000, dtype=np.uint16), maxent.MOST_ROWS).ravel()
    assert ROWS <= flat.max() < maxent.MOST_ROWS
