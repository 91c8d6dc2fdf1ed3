"""Quality rules against plain counts; the forest sets odd rows apart; verdicts keep columns."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from fixtures import DOCS, awkward

from panelwise.llm import quality_forest as q

LABELS = "doc_id long, quality int, toxic int"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text)) if words else 0
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def corpus(rng, n=300):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(200)]
    prose = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 120)))
    good = [(i, prose(), "en", "a", 1) for i in range(n)]
    bad = [(n + i, " ".join(f"{w}### $$$" for w in prose().split()), "en", "a", 1) for i in range(n // 6)]
    return good, bad


def test_counts(spark):
    rng = random.Random(4)
    passage = " ".join(f"w{i}" for i in range(12))
    rows = awkward() + [(50, f"{passage} x {passage} y\n# {passage[:30]}", "en", "a", 1), (51, "a b " * 300, "en", "a", 1),
                        (52, " ".join(rng.choice("ab") for _ in range(400)), "en", "a", 1), (53, "\n\n \nq\nq\nq", "en", "a", 1)]
    got = q.rule_statistics(spark.createDataFrame(rows, DOCS)).select("id", *q.COUNTS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], *plain(r[1])) for r in rows), key=str)


def test_odd_rows_have_shorter_paths():
    rng = np.random.default_rng(0)
    pool = rng.normal(size=(500, 3))
    forest = q.grow(pool, 100, 256, 1)
    assert forest.score(np.array([[6.0, 6, 6]]))[0] > np.quantile(forest.score(pool), 0.99)


def test_threshold_gives_up_few_good_rows():
    # Steps 10 and 9 hold bad rows only; step 5 would cost half of the good ones.
    cut = q.threshold([(10, 0, 5), (9, 0, 5), (5, 500, 10), (1, 500, 0)], 0.002)
    assert 6 / q.STEPS / 2 < cut <= 9 / q.STEPS
    assert q.threshold([(3, 10, 0)]) == float("inf")


def test_bad_rows_go_and_good_ones_stay(spark):
    good, bad = corpus(random.Random(1))
    docs = spark.createDataFrame(good + bad, DOCS)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good[::2]] + [(r[0], 0, 0) for r in bad[::2]] + [(None, 1, 0), (1, None, 0)], LABELS)
    kept = q.keep_good(docs, labels)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns
    assert ids == {r.id for r in q.judge(docs, labels).where("kept").collect()}
    assert len(ids & {r[0] for r in good}) >= 0.98 * len(good) and len(ids & {r[0] for r in bad}) <= 0.1 * len(bad)


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, 1) for r in awkward()], DOCS + ", n_words int")
    none = spark.createDataFrame([], LABELS)
    got = {(r.id, r.n_words): r.kept for r in q.judge(docs, none).collect()}
    assert all(kept == (n >= 20 and i != 6) for (i, n), kept in got.items() if n < 30 or i == 6)
    assert q.judge(docs.limit(0), none).collect() == []
