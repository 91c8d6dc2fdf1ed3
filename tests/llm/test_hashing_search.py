"""Exact top-k against all pairs."""

from __future__ import annotations

import random

import pytest

from panelwise.llm import hashing_search as hs


def plain(points, queries, k):
    out = []
    for q, a in queries:
        near = sorted(((a ^ b) & (1 << 64) - 1).bit_count() * 10**9 + i for i, b in points if i != q)[:k]
        out += [(q, n + 1, v % 10**9, v // 10**9) for n, v in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("n", [3, 400])
def test_against_all_pairs(spark, n):
    rng = random.Random(n)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    centre = rng.getrandbits(64)
    points = [(i, signed(rng.getrandbits(64))) for i in range(n)]
    points += [(1000 + i, signed(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))) for i in range(n)] + [(2000 + i, signed(centre)) for i in range(n)]
    queries = [p for p in points if p[0] % 40 == 0]
    odd = [(None, 5), (7777, None), points[0]]
    table = spark.createDataFrame(points + odd, "id long, code long")
    got = hs.neighbours(table, spark.createDataFrame([*queries, queries[0], (None, 1)], "id long, code long"), 6)
    assert sorted(map(tuple, got.select("query_id", "rank", "id", "distance").collect())) == plain(points, queries, 6)


def test_empty_and_codes(spark):
    none = spark.createDataFrame([], "id long, code long")
    assert hs.neighbours(none, none).collect() == []
    vectors = spark.createDataFrame([([1.0] + [-1.0] * 62 + [2.0],), ([0.0, None, 3.0],), ([],), (None,)], "v array<float>")
    assert [r[0] for r in vectors.select(hs.sign_code(vectors.v)).collect()] == [-(1 << 63) + 1, 1, 0, None]
