import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm.packing import best_plan, configurations, pack_documents, plan
from millrace.llm.word_ids import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


def laid_out(counts, found):
    """(sequence, offset, length) of every piece, from the placements."""
    out = []
    seen = defaultdict(list)
    for length, first, each, start, many, offset in found:
        seen[length].append((first, each * many))
        out += [(start + k // each, offset + k % each * length, length) for k in range(each * many)]
    for length, runs in seen.items():
        at = 0
        for first, n in sorted(runs):
            assert first == at
            at += n
        assert at == counts[length]
    assert set(seen) == {x for x, n in counts.items() if n}
    return out


def check(counts, capacity, n, found):
    by = defaultdict(list)
    for s, o, x in laid_out(counts, found):
        by[s].append((o, x))
    assert len(by) == n
    for parts in by.values():
        at = 0
        for o, x in sorted(parts):
            assert o == at
            at += x
        assert at <= capacity


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_near_the_bound(seed):
    rng = random.Random(seed)
    capacity = rng.choice([64, 500, 2048])
    shape = rng.choice([lambda: rng.randint(1, capacity), lambda: min(capacity, 1 + int(rng.expovariate(6 / capacity))), lambda: rng.choice([capacity, capacity // 2, capacity // 3 + 1, 3])])
    counts = Counter(shape() for _ in range(rng.choice([10, 800, 20000])))
    n, found = best_plan(counts, capacity)
    check(counts, capacity, n, found)
    bound = max(-(-sum(x * c for x, c in counts.items()) // capacity), sum(c for x, c in counts.items() if 2 * x > capacity))
    if len(counts) < 8:  # the relaxation over all sizes
        bound = sum(x for _, x in configurations(list(counts), list(counts.values()), capacity))
    assert n <= 1.06 * bound + 2


@pytest.mark.parametrize("groups,small", [(1, 0.1), (5, 0.5), (500, 0.01)])
def test_settings_change_the_plan_not_its_wholeness(groups, small):
    rng = random.Random(1)
    counts = Counter(rng.randint(1, 300) for _ in range(3000))
    n, found = plan(counts, 300, groups, small)
    check(counts, 300, n, found)


def test_configurations_cover_the_demand():
    sizes, demand = [45, 36, 31, 14], [97, 610, 395, 211]
    found = configurations(sizes, demand, 100)
    assert all(np.array(sizes) @ c <= 100 for c, _ in found)
    assert np.allclose(sum(c * x for c, x in found), demand)
    assert abs(sum(x for _, x in found) - 452.25) < 1e-6  # a textbook instance's optimum


def test_ids_are_the_library_s():
    rng = random.Random(1)
    letters = "ab cd eéÉßİıſK's't mtre\n\t \x1c\x85\xa0 　123ñǰJ̌Aͅ漢字🙂.,!###&&&ΣΑΣ<|endoftext|><|EndOfText|>Ⅷ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, "", "a" * 5000]
    library, words = Tokenizer.from_file(PATH), WordIds(PATH, memo=300)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], words.encode(pa.array(texts[at : at + 100], pa.string())), strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_ids_of_every_letter_before_punctuation():
    """Composition takes some letters apart, and then the mark is one run with what follows."""
    library, words = Tokenizer.from_file(PATH), WordIds(PATH)
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha() and not "\uac00" <= chr(c) <= "\ud7a3" and not "\u3400" <= chr(c) <= "\U0003ffff" or unicodedata.category(chr(c))[0] in "NM"]
    for tail in ".,;:!?#$%&*|":
        texts = [" ".join(x + tail for x in letters[at : at + 2000]) for at in range(0, len(letters), 2000)]
        for text, ids in zip(texts, words.encode(pa.array(texts)), strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packed_table(docs):
    library = Tokenizer.from_file(PATH)
    found = pack_documents(docs, PATH).toPandas()
    want = Counter()
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[r["doc_id"], k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], dtype="<u4").tobytes())] += 1
    assert Counter((None if i != i else i, p, s, n, c) for i, p, s, n, c in found[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
    for _, rows in found.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == (rows["length"].cumsum() - rows["length"]).tolist() and rows["length"].sum() <= 2048


def test_empty_table(none):
    assert pack_documents(none, PATH).count() == 0
