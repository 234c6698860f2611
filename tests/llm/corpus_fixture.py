"""Rows that every corpus operator must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __text string, Band string"


def messy_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 977} of the {i}" for i in range(9000))
    twice = "the same words again and again in two documents of one text only here"
    texts = [
        (1, twice, "en", "a"),
        (2, twice, "en", "a"),
        (2, twice, "en", "a"),
        (3, None, "de", None),
        (4, "", None, "b"),
        (5, " \t\r\n\x0b\x0c ", "xx", "b"),
        (6, long, "en", "a"),
        (None, "a row without an id but with a few words in it", "en", "c"),
        (None, None, None, None),
        (7, "kurz", "de", "c"),
        (8, "<|endoftext|> it's naïve 日本語 🎉 e\u0301 ###$$$ 12 345\n\n\na | b\xa0c", "fr", "c"),
        (8, "another text under one id with enough words to matter here", "en", "a"),
        (9, "UPPER lower MiXeD " * 40, "en", "a"),
    ]
    return [(i, t, g, s, None, "clash", None) for i, t, g, s in texts]
