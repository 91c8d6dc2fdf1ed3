"""Awkward documents that every operator has to take: NULLs, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort " * 40000 + "ende"
PROSE = "the cat sat on the mat and looked at the dog that slept near the old door of the house"


def awkward() -> list[tuple]:
    return [
        (1, PROSE, "en", "a", 5), (1, PROSE, "en", "a", 5), (2, PROSE, None, None, None), (3, None, "en", "a", 0),
        (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 4), (6, LONG, "de", "a", len(LONG)), (None, PROSE + " now", "en", "a", 1),
        (None, None, None, None, None), (7, "one", "fr", "c", 3), (8, "x" * 100000, "fr", "c", 100000),
        (9, "ÀB é ÀB é \U0001f600 ÀB é\nline\nline\n\nline", "fr", "c", 20), (10, PROSE.upper(), "en", "a", 1),
    ]
