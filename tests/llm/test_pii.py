"""Personal data against plain regular expressions; redaction; the labelers' model."""

from __future__ import annotations

import re

import numpy as np
from fixtures import DOCS, awkward
from pyspark.sql import Row
from pyspark.sql import functions as F

from panelwise.llm import pii


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(x) <= 255 for x in h.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda h: 14 <= len(re.sub("[^0-9]", "", h)) <= 19 and luhn(re.sub("[^0-9]", "", h))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 10 <= len(re.sub("[^0-9]", "", h)) <= 15),
]
TEXTS = [
    "a@b.c%d@e.fr x@y", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.0255", "+1 (743) 555-3824 +", "4111 1111 1111 1111 41111111111111112",
    "\U0001f600 me@x.org é \U0001f600 you@y.org", "x" * 20000 + " a@b.cc", "@", "_a@b.c_a@d.ef@g.hi", "4111-1111-1111-1111- +49 30 1234567, 8.8.8.8",
    "a@b@c.de a@.b a@b..c a@b.c.", "1.1.1.1" * 50, None, "",
]


def plain(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PLAIN) for m in re.finditer(p, text or "") if ok(m[0])]
    return ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans(spark):
    rows = list(enumerate(TEXTS)) + [(r[0], r[1]) for r in awkward()]
    got = pii.detect(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, base string"))
    got = sorted((str(r[0]), r[1]) for r in got.select("doc_id", pii.listing(F.col("base"))).collect())
    assert got == sorted((str(i), plain(t)) for i, t in rows)


def test_redact_keeps_columns_and_other_text(spark):
    docs = spark.createDataFrame(awkward() + [(20, "mail me@x.org or 10.0.0.1!", "en", "a", 26)], DOCS)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    rows = sorted(map(str, out.collect()))
    clean = "mail <EMAIL> or <IP>!"
    want = [*docs.where("doc_id <> 20 OR doc_id IS NULL").collect(), Row(doc_id=20, text=clean, lang="en", source="a", n_chars=len(clean))]
    assert rows == sorted(map(str, want))
    assert pii.redact(docs.limit(0)).collect() == []


def test_model_learns_reliabilities():
    """Three labelers of different reliability; with fewer that know anything, agreement alone can't tell which is right."""
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    sign = np.where(truth, 1, -1)
    flip = lambda p: np.where(rng.random(4000) < p, sign, -sign)
    votes = np.stack([flip(0.95), flip(0.9), flip(0.85)], axis=1)
    cells = np.column_stack([np.full(4000, 5), votes, np.where(truth, 3, 1), np.zeros(4000, int), np.ones(4000, int)])
    model = pii.estimate(cells)
    right = lambda j: (model.reliability[j, 1, 2] + model.reliability[j, 0, 0]) / 2
    assert right(0) > right(1) > right(2) and abs(right(0) - 0.95) < 0.02 and abs(right(2) - 0.85) < 0.02
    score = model.bias + sum(w * (cells[:, pii.CELL.index(c)] == v) for (c, v), w in model.weights.items())
    assert ((score > 0) == truth).mean() > 0.95
    assert not pii.estimate(np.zeros((0, 7), int)).weights


def test_tokens_are_judged_by_their_whole_length(spark):
    late, long = "ghp_" + "aBcDeFgHiJkLmNoPqRsT" + "7uV9", "k" * 600 + "1" * 600
    texts = [
        (late, [late]), (f"x {long} y", [long]), ("1" * 24 + "ab", ["1" * 24 + "ab"]), ("a" * 30, []), (late + ".", []), (f"https://a.io/{late}", [late]),
        ("a/" * 200000 + ".", []), ("555-123-4567 and 1234567890/555-123-4567 and " + late, ["555-123-4567", "555-123-4567", late]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, text string")
    got = docs.select("i", F.transform(pii.wide_matches(F.col("text")), lambda m: m["hit"]).alias("hits")).collect()
    assert {r.i: r.hits for r in got} == {i: hits for i, (_, hits) in enumerate(texts)}


def test_redact_keeps_columns_of_any_name(spark):
    names = ["spans", "base", "_text", "_done", "_base", "_wide", "row", "at"]
    rows = [(1, "write to me@x.org now", *names), (2, "nothing", *names), (None, None, *names)]
    got = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)))
    assert got.columns == ["doc_id", "text", *names]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "write to <EMAIL> now", *names), *rows[1:]], key=str)


def test_many_hits_in_one_text(spark):
    import time

    parts = [f"x{i % 7} 10.{i % 200}.3.{i % 250}" for i in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(parts), "en", "a", 1), (2, parts[0], "en", "a", 1)], DOCS)
    start = time.time()
    got = {r.doc_id: r.base for r in pii.detect(docs).collect()}
    assert time.time() - start < 60
    at, want = 0, []
    for p in parts:
        want.append((at + p.index(" ") + 1, at + len(p)))
        at += len(p) + 1
    assert [(b.start, b.stop) for b in got[1]] == want and len(got[2]) == 1
