"""Documents that every operator must survive. The columns `size`, `key` and `n` clash with operators' own names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, n long"

_WORDS = "the quick brown fox jumps over the lazy dog and the small cat sleeps by the warm fire while rain falls on the old roof of the house".split()
LONG = " ".join(_WORDS[(k * k + k // 7) % len(_WORDS)] + ("." if k % 11 == 0 else "") for k in range(20000))

TEXTS = [
    (0, " ".join(_WORDS * 3)),
    (1, " ".join(_WORDS * 3)),  # a copy
    (2, "  ".join(_WORDS * 3) + "\n"),  # equal but for blanks
    (3, " ".join(_WORDS * 3)[:-5] + "barns"),  # a near copy
    (4, ""),
    (5, None),
    (6, " \t\n\x0b\x0c\r "),
    (7, "word"),
    (8, "Word"),
    (9, LONG),
    (10, LONG + " end"),
    (11, "x" * 70000),
    (12, "é ñ ß 漢字 🙂 <|endoftext|> é     z"),
    (13, "one two"),
    (13, "one two"),  # a repeated row
    (14, "ONE TWO"),
    (15, "<|EndOfText|> don't I'll 12345 ### ***"),
    (None, "no id at all"),
]
ROWS = [(i, t, "en", None if k % 5 == 4 else f"src{k % 3}", len(t or ""), "s", "k", k) for k, (i, t) in enumerate(TEXTS)]
