"""License scans by conditional compression.

A template's *anchor* is the longest of its required words. Around each anchor in a text the template's other words are
aligned with the words on either side at the least number of edits (missing, changed or added words). The template is
confirmed if its required words stand unchanged (``licence`` is a spelling of ``license``), no refused word is
added and at most ``MOST_CHANGED`` per cent of its words, but one in any case, are edited. Optional words may be missing, and
up to ``HOLDER`` words (year, holder) may follow them, without counting. Of several confirmed templates that wins whose
text as a zstandard raw dictionary saves most bytes when the ``REACH`` words on either side are compressed.

Line breaks and comment leaders do not count; after a notice the scan goes on at its end. Any confirmed notice holds its anchor, so none is missed.
Work is linear in the text. Rows are handled one by one, nothing is shuffled.

Defined results: NULL and empty texts have no finding; ids may be NULL or repeated and come back as they
are; equal savings are ranked by the template's name; n_changes and changes list optional words too, and start and stop are
those of the first and last words shared with the template; other columns are not read; positions are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices by license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "all-rights-reserved": "Copyright. All rights reserved.",
}
#: Words by license that must stand unchanged; of other templates, words with digits or else the longest.
REQUIRED = {
    "Apache-2.0": "apache license 2.0",
    "BSD-3-Clause": "redistribution source binary",
    "CC-BY-4.0": "cc by 4.0",
    "CC-BY-NC-4.0": "cc by-nc 4.0",
    "CC-BY-SA-4.0": "cc by-sa 4.0",
    "GPL-2.0": "gnu general public license 2",
    "GPL-3.0": "gnu general public license 3",
    "LGPL-2.1": "gnu lesser general public license 2.1",
    "MIT": "mit license",
    "MPL-2.0": "mozilla public license 2.0",
    "all-rights-reserved": "all rights reserved",
}
OPTIONAL = {"all-rights-reserved": "copyright"}
#: Words that must not be added: with them the notice is another one.
REFUSED = {
    "CC-BY-4.0": "nc nd sa", "CC-BY-NC-4.0": "nd sa", "CC-BY-SA-4.0": "nc nd",
    "GPL-2.0": "affero lesser library", "GPL-3.0": "affero lesser library", "LGPL-2.1": "affero",
    "MIT": "modified", "all-rights-reserved": "license licensed licence licenced redistribution released",
}
NEVER_ADDED = {"no", "not"}
SPELLED = {"licence": "license", "licenced": "licensed"}
PART = re.compile(r"\w+(?:[.-]\w+)*")
#: Comment leaders that are words.
LEADER = re.compile(r"(?im)^[ \t]*(?:rem|dnl)(?=\s)")
HOLDER = 12
REACH = 40
MOST_CHANGED = 20
LEVEL = 3
FINDING = "doc_id long, start long, stop long, license string, saved_bytes long, n_changes long, changes string"


def compressors(templates: dict[str, str]) -> tuple:
    plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    with_dict = {}
    for name, text in sorted(templates.items()):
        data = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        with_dict[name] = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)
    return plain, with_dict


@dataclass
class Template:
    name: str
    words: list[str]
    required: set[str]
    optional: set[str]
    refused: set[str]
    anchor: int

    @property
    def allowed(self) -> int:
        return max(1, MOST_CHANGED * len(self.words) // 100)


def template(name: str, text: str) -> Template:
    words = PART.findall(text.lower())
    digits = [w for w in words if any(c.isdigit() for c in w)]
    required = REQUIRED[name].split() if name in REQUIRED else digits or [max(words, key=len)]
    anchor = max(required, key=lambda w: (len(w), words.index(w)))
    refused = NEVER_ADDED.union(REFUSED.get(name, "").split()).difference(words)
    return Template(name, words, set(required), set(OPTIONAL.get(name, "").split()), refused, words.index(anchor))


def same(want: str, have: str) -> bool:
    return want == have or SPELLED.get(have) == want


def side(t: Template, want: list[str], have: list[str]) -> tuple | None:
    """(edits, optional words missing, changes, used, pairs) of the best alignment of all of ``want`` with the first words
    of ``have``, both read away from the anchor; None if there is none."""
    row: list[tuple | None] = []
    for a in range(len(want) + 1):
        above, row = row, []
        for b in range(len(have) + 1):
            ways = [(0, 0, 0, ())] if not a and not b else []
            w, h = want[a - 1] if a else "", have[b - 1] if b else ""
            free = w in t.optional
            if a and b and above[b - 1]:
                edits, missing, n, pairs = above[b - 1]
                if same(w, h):
                    ways.append((edits + (w != h), missing, n + (w != h), (*pairs, (w, h))))
                elif w not in t.required and h not in t.refused:
                    ways.append((edits + (not free), missing + free, n + 1, (*pairs, (w, h))))
            if a and above[b] and w not in t.required:
                edits, missing, n, pairs = above[b]
                ways.append((edits + (not free), missing + free, n + 1, (*pairs, (w, ""))))
            if b and row[b - 1] and h not in t.refused:
                edits, missing, n, pairs = row[b - 1]
                holder = a < len(want) and want[a] in t.optional
                ways.append((edits + (not holder), missing, n + 1, (*pairs, ("", h))))
            row.append(min(ways, default=None))
    best = min(((*c[:3], b, c[3]) for b, c in enumerate(row) if c), default=None)
    if best is None:
        return None
    edits, missing, n, used, pairs = best
    pairs = list(pairs)
    for i in range(len(pairs) - 1, -1, -1):  # what lies beyond the last shared word is missing, not changed
        w, h = pairs[i]
        if h and same(w, h):
            break
        if h:
            pairs[i], used = (w, ""), used - 1
    return edits, missing, n, used, pairs


def changes(pairs: list[tuple[str, str]]) -> str:
    """The differences, neighbouring ones together."""
    runs = [list(g) for equal, g in groupby(pairs, lambda p: p[0] == p[1]) if not equal]
    return "; ".join(f"{' '.join(w for w, _ in r if w)} > {' '.join(h for _, h in r if h)}" for r in runs)


def confirm(t: Template, words: list[str], at: int, low: int, high: int) -> tuple | None:
    """(changed words, differences, first word, end word) of the notice with its anchor at ``at``, inside [low, high)."""
    before, behind = t.words[: t.anchor][::-1], t.words[t.anchor + 1 :]
    left = max(low, at - len(before) - t.allowed - (HOLDER if t.optional else 0))
    right = min(high, at + 1 + len(behind) + t.allowed)
    if not t.required <= {SPELLED.get(w, w) for w in words[left:right]}:
        return None
    one, two = side(t, before, words[left:at][::-1]), side(t, behind, words[at + 1 : right])
    off = words[at] != t.words[t.anchor]
    if one is None or two is None or one[0] + two[0] + off > t.allowed:
        return None
    pairs = [*one[4][::-1], (t.words[t.anchor], words[at]), *two[4]]
    return one[2] + two[2] + off, changes(pairs), at - one[3], at + 1 + two[3]


def notices(text: str, known: list[Template], plain, with_dict: dict) -> Iterator[tuple]:
    """(start, stop, license, saved bytes, changed words, differences) of every confirmed notice, from left to right."""
    leaders = {m.end() for m in LEADER.finditer(text)}
    spans = [m.span() for m in PART.finditer(text) if m.end() not in leaders]
    words = [text[a:b].lower() for a, b in spans]
    by_anchor: dict[str, list[Template]] = {}
    for t in known:
        by_anchor.setdefault(t.words[t.anchor], []).append(t)
    low = 0
    for at, word in enumerate(words):
        for_word = by_anchor.get(SPELLED.get(word, word))
        if for_word is None or at < low:
            continue
        found = [(t, f) for t in for_word if (f := confirm(t, words, at, low, len(words)))]
        if found:
            data = text[spans[max(low, at - REACH)][0] : spans[min(len(words), at + REACH + 1) - 1][1]].lower().encode()
            alone = len(plain.compress(data))
            grown, _, t, (n, listed, a, b) = min(((len(with_dict[t.name].compress(data)) - alone, t.name, t, f) for t, f in found), key=lambda x: x[:2])
            yield spans[a][0], spans[b - 1][1], t.name, -grown, n, listed
            low = b


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """FINDING: a row for each confirmed notice in a text."""
    names = [x.split()[0] for x in FINDING.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, with_dict = compressors(templates)
        known = [template(name, text) for name, text in sorted(templates.items())]
        anchors = {t.words[t.anchor] for t in known}
        spellings = anchors | {other for other, usual in SPELLED.items() if usual in anchors}
        some = re.compile("|".join(map(re.escape, sorted(spellings))), re.IGNORECASE)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and some.search(text):
                    for start, stop, *found in notices(text, known, plain, with_dict):
                        rows.append((doc_id, start, stop, *found))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FINDING)
