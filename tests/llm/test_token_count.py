import random

import public_tokenizers
from tokenizers import Tokenizer

from millrace.llm.token_count import TokenCounter, count_tokens, merges_left

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_are_the_library_s():
    rng = random.Random(1)
    letters = "ab cd eé'sdmtre\n\t  \r\x0b\x1c\x1f\x85\xa0 　 123ñ漢字🙂́.,!<|endoftext|>​﻿٣Ⅷ𝟘"
    library, counter = Tokenizer.from_file(PATH), TokenCounter(PATH, memo=500)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + rng.choice(["", "", "<|endoftext|> x"])
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    for text in ("x" * 20000, "ab1" * 5000, " " * 3000, "\n \n" * 900):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_merges_take_the_lowest_rank_first_then_the_leftmost():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 5, ("a", "a"): 2}
    assert merges_left(list("abc"), ranks) == 1
    assert merges_left(list("abab"), ranks) == 2
    assert merges_left(list("aaa"), ranks) == 2
    assert merges_left([], ranks) == 0 and merges_left(["z"], ranks) == 1


def test_table(docs, none):
    library = Tokenizer.from_file(PATH)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 1024) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in count_tokens(docs, PATH).collect()), key=str) == want
    assert count_tokens(none, PATH).count() == 0
