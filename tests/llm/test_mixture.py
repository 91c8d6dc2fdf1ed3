"""Hierarchical budgets against a plain recursion, and token prefixes against sorting."""

from __future__ import annotations

import hashlib
import random
import re
from fractions import Fraction

from fixtures import DOCS, awkward
from pyspark.sql import functions as F

from panelwise.llm import mixture


def share(budget, children):
    """children: (cap, weight, name); the plain water-filling."""
    order = sorted(children, key=lambda c: (Fraction(c[0], c[1]), c[2] is not None, c[2] or ""))
    out, given = {}, 0
    for i, (cap, w, name) in enumerate(order):
        rest, width = budget - given, sum(c[1] for c in order[i:])
        if cap * width >= rest * w:
            return out | {n: min(c, rest * v // width) for c, v, n in order[i:]}
        out[name], given = cap, given + cap
    return out


def plain(rows, epochs, budget=None):
    leaves = {}
    for doc_id, text, lang, source, domain in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        if n:
            leaves.setdefault((domain, lang, source), []).append((doc_id, n))
    cap = {k: epochs * sum(n for _, n in v) for k, v in leaves.items()}
    total = sum(cap.values()) // epochs
    below = lambda prefix: sum(c for k, c in cap.items() if k[:len(prefix)] == prefix)
    tables = [mixture.DOMAIN_WEIGHTS, mixture.LANG_WEIGHTS, mixture.SOURCE_WEIGHTS]

    def down(prefix, amount):
        if len(prefix) == 3:
            return {prefix: amount}
        names = {k[len(prefix)] for k in leaves if k[:len(prefix)] == prefix}
        given = share(amount, [(below((*prefix, n)), tables[len(prefix)].get(n, 1), n) for n in names])
        return {k: v for n, a in given.items() for k, v in down((*prefix, n), a).items()}

    out = []
    for leaf, amount in down((), min(total if budget is None else budget, sum(cap.values()))).items():
        tokens = cap[leaf] // epochs
        passes, rest = divmod(amount, tokens)
        key = lambda i: hashlib.md5(":".join([str(mixture.SEED), str(passes)] + ([] if i is None else [str(i)])).encode()).hexdigest()
        units = {}
        for i, n in leaves[leaf]:
            units[key(i)] = units.get(key(i), 0) + n
        at, chosen = 0, set()
        for k in sorted(units):
            at += units[k]
            if at > rest:
                break
            chosen.add(k)
        out += [(i, passes + (key(i) in chosen)) for i, _ in leaves[leaf] if passes + (key(i) in chosen)]
    return sorted(out, key=str)


def test_against_plain(spark, monkeypatch):
    monkeypatch.setattr(mixture, "PREFIX_ROWS", 5)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "a", "b", None]), rng.choice(["d0", "d1", "d3"]))
            for i in range(400)] + [(7, "w w", "en", "hot", "d0"), (None, "w", "en", "a", "d0"), (None, "w w", "en", "a", "d0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    for budget in (None, 500, 10**9):
        got = mixture.draws(docs, domain=F.col("domain"), budget=budget)
        assert sorted(((r.doc_id, r.copies) for r in got.collect()), key=str) == plain(rows, mixture.MAX_EPOCHS, budget)


def test_awkward_rows(spark):
    docs = spark.createDataFrame(awkward(), DOCS)
    out = mixture.mix(docs)
    assert out.columns == docs.columns
    copies = sum(r.copies for r in mixture.draws(docs).collect())
    assert out.count() == copies > 0
    assert mixture.mix(docs.limit(0)).collect() == []
