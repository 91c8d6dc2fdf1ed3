"""Near-duplicates of the pipeline against the Jaccard similarity of all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from fixtures import DOCS, awkward
from pyspark.sql import functions as F

from panelwise.llm import jaccard, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def edited():
    """40 texts, each with a copy in which some words are changed, and one of 5 at a similarity below."""
    rng = random.Random(6)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice([100, 300, 1000]))]
        copy = list(words)
        for at in range(7, len(words), 60 if i % 5 else 30):
            copy[at] = "changed"
        rows += [(2 * i, " ".join(words), "en", "a", 1), (2 * i + 1, " ".join(copy), "en", "a", 1)]
    return rows


def test_pairs_at_the_threshold(spark, edited):
    kept = {r.doc_id for r in corpus_pipeline.dedup(spark, spark.createDataFrame(edited, DOCS), "").collect()}
    want = set()
    for (i, x, *_), (j, y, *_) in zip(edited[::2], edited[1::2]):
        a, b = plain_set(x), plain_set(y)
        want |= {i} if len(a & b) >= 0.8 * len(a | b) else {i, j}
    assert kept == want and 40 < len(want) < 60


def test_awkward_rows_and_large_families(spark):
    docs = spark.createDataFrame(awkward(), DOCS)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7, 8, 9]
    assert jaccard.keep_one(docs.limit(0)).collect() == []
    words = [f"v{i}" for i in range(200)]
    family = spark.createDataFrame([(i, " ".join([*words[:i], "x", *words[i + 1:]]), "en", "a", 1) for i in range(150)], DOCS)
    assert [r.doc_id for r in jaccard.keep_one(family, band_rows=8).collect()] == [0]


def plain_classes(texts):
    """The least place of each text's class, by all pairs."""
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_large_bands_connect_what_all_pairs_connect(spark, monkeypatch, seed):
    """Chains, families and texts that only share a passage, all in a few crowded bands."""
    monkeypatch.setattr(jaccard, "bands", lambda hashes: (hashes[:1] * 0).view("int64").repeat(2))
    rng = random.Random(seed)
    texts = []
    for f in range(6):
        words = [f"f{f % 3}w{i}" if f < 3 or i < 70 else f"g{f}w{i}" for i in range(100)]
        for _ in range(22):
            texts.append(" ".join(words))
            words = list(words) if rng.random() < 0.7 else texts[rng.randrange(len(texts))].split()
            for _ in range(rng.choice([1, 2, 3])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    for rounds in (1, 2):
        roots = jaccard.connected(jaccard.links(jaccard.texts(docs, "text"), 8, rounds))
        ids = jaccard.texts(docs, "text").join(docs, "text").join(roots, F.col("content") == F.col("node"), "left")
        got = {}
        for r in ids.select("doc_id", F.coalesce("root", "content").alias("root")).collect():
            got.setdefault(r.root, set()).add(r.doc_id)
        want = {}
        for i, root in enumerate(plain_classes(texts)):
            want.setdefault(root, set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and 5 < len(want) < 100


def test_a_passage_too_short_to_link_makes_no_pairs(spark):
    """Texts with 83 % of their shingles in common meet nowhere, those with 95 % all do."""
    passage = [f"p{i}" for i in range(100)]
    for own, pairs in ((20, 0), (5, 780)):
        docs = [(i, " ".join([*passage, *(f"t{i}w{j}" for j in range(own))]), "en", "a", 1) for i in range(40)]
        found = jaccard.sets(jaccard.texts(spark.createDataFrame(docs, DOCS), "text"))
        assert jaccard._prefix_pairs(found.select("content", F.col("content").alias("root")), found).count() == pairs


def test_fingerprints_find_a_pair_that_no_band_holds(spark):
    """8 of 10 shingles in common, 4 differing bits, no common band; and equal fingerprints alone link nothing."""
    common = "dwl byc ouv lhp jdz lms mag uqi xha jqg ysv waz"
    a, b = f"{common} rqh", f"{common} kih"
    x, y = (jaccard.shingles(t.encode()) for t in (a, b))
    assert not (jaccard.bands(x) == jaccard.bands(y)).any()
    differ = lambda a, b: bin((simhash.fingerprint(a.encode(), 5) ^ simhash.fingerprint(b.encode(), 5)) & (1 << 64) - 1).count("1")
    often = " ".join(["one two three four five"] * 40)
    apart = [f"{often} {' '.join(f'{k}{i}' for i in range(10))}" for k in "uv"]
    assert differ(a, b) == 4 and differ(*apart) <= 4
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate([a, b, *apart])], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.dedup(spark, docs, "").collect()) == [0, 2, 3]
