"""Runs against a plain search of every lag; strongest runs, collapsed texts, awkward rows, the query's digests."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from fixtures import DOCS, awkward
from pyspark.sql import functions as F

from panelwise.llm import periodic
from panelwise.llm.queries import periodic_runs


def plain(words, least=6, repeats=4):
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            unit = words[start:start + length]
            if i > start and length >= max(least, repeats * q) and not any(unit[d:] == unit[:-d] for d in range(1, q)):
                out.append((start, length, q))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def odd_words(rng, n, letters):
    words = []
    while len(words) < n:
        part = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        words += part * (rng.randint(1, 8) if rng.random() < 0.5 else 1)
    return words


@pytest.mark.parametrize(("least", "repeats"), [(6, 4), (3, 3), (10, 3), (6, 5)])
def test_runs_equal_a_plain_search(least, repeats):
    rng = random.Random(least * 10 + repeats)
    for _ in range(1500):
        words = odd_words(rng, rng.randint(0, 60), rng.choice(["a", "ab", "abc", "abcdefgh"]))
        assert periodic.find_runs(words, least, repeats) == plain(words, least, repeats)


def test_runs_touching_the_ends_nested_and_long():
    assert periodic.find_runs(list("aaaaa")) == [] and periodic.find_runs(list("aaaaaa")) == [(0, 6, 1)]
    assert periodic.find_runs(list("xabababab")) == [(1, 8, 2)] and periodic.find_runs(list("abababa")) == []
    nested = (list("aaaaaab") * 4)
    assert (0, 28, 7) in periodic.find_runs(nested) and (0, 6, 1) in periodic.find_runs(nested) and len(periodic.find_runs(nested)) == 5
    assert periodic.find_runs(["a"] * 200_000) == [(0, 200_000, 1)]
    unit = [str(i) for i in range(999)]
    assert periodic.find_runs(unit * 40 + unit[:7]) == [(0, 999 * 40 + 7, 999)]


def test_small_bounds_are_refused(spark):
    with pytest.raises(ValueError):
        periodic.runs(spark.createDataFrame([], DOCS), repeats=2)


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in awkward()], DOCS + ", runs int, id int")
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.runs(docs).collect()), key=str)
    expected = []
    for i, text, *_ in awkward():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = plain(words) if len(words) < 1000 else [(0, 40000, 1)]
        expected.append((i, len(words), found, " ".join(kept(words, found))))
    assert got == sorted(expected, key=str)
    assert periodic.runs(docs.limit(0)).collect() == []


def test_slices_cut_batches_between_texts(spark):
    rows = [(i, "a b " * 300_000 if i % 3 else "c " * 7, "en", "a", 1) for i in range(9)]
    got = {r.id: r.runs for r in periodic.runs(spark.createDataFrame(rows, DOCS).coalesce(1)).select("id", "runs").collect()}
    assert got == {i: [(0, 600_000, 2)] if i % 3 else [(0, 7, 1)] for i in range(9)}


def test_strongest_compares_exactly(spark):
    big = 10 ** 9
    rows = [([(5, 9, 2), (1, 18, 4), (0, 9, 2)],), ([(0, 3 * big + 1, big), (0, 3 * big + 5, big + 1)],), ([],)]
    df = spark.createDataFrame(rows, f"runs {periodic.RUNS}").select(periodic.strongest(F.col("runs")).alias("b"))
    # Runs come by start; of equal exponents the first stays.
    assert [r.b and tuple(r.b) for r in df.collect()] == [(5, 9, 2), (0, 3 * big + 5, big + 1), None]


def digest(words, doc_id):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(kept(words, runs))))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [r for r in awkward() if r[0] != 6]
    rows += [(100 + i, " ".join(odd_words(rng, rng.randint(1, 70), "abcdefghij")), "en", "a", 1) for i in range(300)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs(spark, str(tmp_path)).collect()
    expected = [digest(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""), r[0]) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows if r[0]) > 20
