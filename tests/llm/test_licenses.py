"""License notices: exact positions, tolerated and refused differences in wording."""

from __future__ import annotations

import random
import re
from collections import Counter

from fixtures import DOCS, awkward

from panelwise.llm import licenses


def test_findings(spark):
    filler = "é words " * 500
    rows = [
        (1, "intro\n" + licenses.TEMPLATES["MIT"] + "\nend"), (2, filler + licenses.TEMPLATES["GPL-3.0"].upper() + " " + filler),
        (3, "This work is licensed under the GNU General Public License, version 4."), (4, "Licensed under CC BY-NC 4.0."),
        (5, "This software is licensed under the GNU General Public License, version 2."), (6, "a licensed driver with a license to fish"),
        (7, licenses.TEMPLATES["MIT"] + "\n" + licenses.TEMPLATES["Apache-2.0"]), (7, licenses.TEMPLATES["MIT"]),
    ]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows] + awkward(), DOCS)
    got = licenses.scan(docs).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [
        (1, "MIT"), (2, "GPL-3.0"), (4, "CC-BY-NC-4.0"), (5, "GPL-2.0"), (7, "Apache-2.0"), (7, "MIT"), (7, "MIT")]
    texts = dict(rows)
    by = {r.doc_id: r for r in got if r.doc_id < 7}
    assert texts[1][by[1].start:by[1].stop] == licenses.TEMPLATES["MIT"][:-1]
    assert texts[2][by[2].start:by[2].stop] == licenses.TEMPLATES["GPL-3.0"].upper()[:-1]
    assert (by[1].n_changes, by[5].n_changes, by[5].changes) == (0, 1, "work > software")
    assert licenses.scan(docs.limit(0)).collect() == []


def test_long_words_of_several_bytes_a_character(spark):
    """The byte bounds of the search for words lie inside characters."""
    notice = licenses.TEMPLATES["MIT"]
    rows = [(i, "許可" * 900 + "a" * i + " " + notice + " " + "a" * i + "許可" * 900) for i in range(6)]
    got = licenses.scan(spark.createDataFrame([(i, t, "zh", "a", 1) for i, t in rows], DOCS)).collect()
    assert sorted((r.doc_id, r.license, dict(rows)[r.doc_id][r.start:r.stop]) for r in got) == [(i, "MIT", notice[:-1]) for i in range(6)]


def test_required_optional_and_refused_words(spark):
    cases = [
        ("All rights reserved.", "all-rights-reserved"), ("Copyright 2024 Acme Corp. All rights reserved.", "all-rights-reserved"),
        ("Some rights reserved.", None), ("Released under the BSD License.", None), ("Released under the MIT Licence.", "MIT"),
        ("Published under the MIT License.", "MIT"), ("Licensed under CC BY-ND 4.0.", None), ("Licensed under CC BY ND 4.0.", None),
        ("This work is licensed under the GNU Affero General Public License, version 3.", None),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", None),
    ]
    got = licenses.scan(spark.createDataFrame([(i, t, "en", "a", 1) for i, (t, _) in enumerate(cases)], DOCS)).collect()
    assert {r.doc_id: r.license for r in got} == {i: name for i, (_, name) in enumerate(cases) if name}
    by = {r.doc_id: r for r in got}
    assert (by[1].start, by[1].stop, by[1].n_changes, by[1].changes) == (0, 45, 3, " > 2024 acme corp")
    assert by[0].changes == "copyright > "


def plain_counts(text):
    """Licenses of a whole text: every start of every template, edits one by one; overlapping hits are one."""
    words = [w.lower() for w in re.findall(r"\w+(?:[.-]\w+)*", text)]
    usual = lambda w: {"licence": "license", "licenced": "licensed"}.get(w, w)
    out = Counter()
    for name, template in licenses.TEMPLATES.items():
        want = [w.lower() for w in re.findall(r"\w+(?:[.-]\w+)*", template)]
        need, may = licenses.REQUIRED[name].split(), licenses.OPTIONAL.get(name, "").split()
        no = (set(licenses.REFUSED.get(name, "").split()) | {"no", "not"}) - set(want)
        allowed, none, hits = max(1, len(want) // 5), 99, []
        for low in range(len(words)):
            reach = words[low : low + len(want) + allowed + (12 if may else 0)]
            if not set(need) <= set(map(usual, reach)):
                continue
            cost = {(0, 0): 0}
            for a in range(len(want) + 1):
                for b in range(len(reach) + 1):
                    if a or b:
                        w, h = want[a - 1] if a else "", reach[b - 1] if b else ""
                        out_of = none if w in need else 0 if w in may else 1
                        change = (w != h) if usual(h) == w else none if h in no else out_of
                        add = none if h in no else 0 if a and w in may else 1
                        cost[a, b] = min(cost.get((a - 1, b - 1), none) + change, cost.get((a - 1, b), none) + out_of, cost.get((a, b - 1), none) + add)
            ends = [b for b in range(len(reach) + 1) if cost[len(want), b] <= allowed]
            if ends:
                hits.append((low, low + min(ends)))
        stop = 0
        for low, high in hits:
            out[name] += low >= stop
            stop = max(stop, high)
    return +out


def test_notices_against_a_scan_of_whole_texts(spark):
    rng = random.Random(4)
    junk = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(2):
            words = rng.choice(list(licenses.TEMPLATES.values())).split()
            for _ in range(rng.randint(0, 3)):
                at, kind = rng.randrange(len(words)), rng.randrange(3)
                new = rng.choice(["affero", "lesser", "2024", "mit", "bsd", "not", "licence", "gnu", "the", "Acme"])
                words[at : at + (kind != 2)] = [] if kind == 0 else [new]
            parts += [" ".join(rng.choices(junk, k=16)), " ".join(words)]
        rows.append((i, "\n".join([*parts, "end"]), "en", "a", 1))
    rows += [(100 + r.doc_id, r.text, "en", "a", 1) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect() if r.text]
    got = Counter((r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter({(r[0], name): n for r in rows for name, n in plain_counts(r[1]).items()})
    assert len({name for _, name in got}) > 8


def test_wrapped_and_neighbouring_notices(spark):
    rows = [
        (1, "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided"),
        (2, " * Licensed under the Apache\n * License, Version 2.0\n"), (3, "dnl Released under the\ndnl MIT License."),
        (4, "Released under the MIT License. Or: Licensed under the Apache License, Version 2.0. Copyright 2024 Acme.\nAll rights\nreserved."),
        (5, "Released under the MIT License. " * 50),
    ]
    got = licenses.scan(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS)).collect()
    assert Counter((r.doc_id, r.license) for r in got) == {
        (1, "BSD-3-Clause"): 1, (2, "Apache-2.0"): 1, (3, "MIT"): 1, (4, "MIT"): 1, (4, "Apache-2.0"): 1, (4, "all-rights-reserved"): 1, (5, "MIT"): 50}
    assert next(r.changes for r in got if r.doc_id < 4) == ""
