"""Neighbours against all pairs, on crowded, scattered and tied rows; how far the search has to look."""

import numpy as np
import pytest

from panelwise.operators import neighbours

SCHEMA = "id long, a double, b double, c int"


def plain(rows, k):
    x = np.array([r[1:3] for r in rows])
    span = x.max(0) - x.min(0)
    x = np.where(span > 0, x / np.where(span > 0, span, 1), 0.0)
    c, ids = np.array([r[3] for r in rows]), np.array([r[0] for r in rows])
    out = {}
    for i in range(len(rows)):
        d = ((x[i] - x) ** 2).sum(1) + (c != c[i])
        order = [j for j in np.lexsort((ids, d.round(12))) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), round(float(d[j]), 9)) for j in order]
    return out


def tables():
    rng = np.random.default_rng(2)
    yield "scattered", [(i, *rng.normal(size=2).tolist(), int(rng.integers(3))) for i in range(700)]
    yield "clusters", [(i, *(rng.normal(size=2) * 0.01 + rng.integers(4, size=2)).tolist(), int(rng.integers(2))) for i in range(600)]
    yield "ties", [(i, float(rng.integers(5)), float(rng.integers(3)), int(rng.integers(2))) for i in range(300)]
    yield "one place", [(i, 1.0, 2.0, 3) for i in range(40)]
    yield "few", [(i, float(i), 0.0, 0) for i in range(4)]


@pytest.mark.parametrize(("name", "rows"), list(tables()))
@pytest.mark.parametrize("block", [2000, 16])
def test_equal_to_all_pairs(spark, monkeypatch, name, rows, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    got = {}
    for r in neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), "id", ["a", "b"], ["c"], 5).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.neighbour_id, round(r.distance2, 9))
    assert {i: [v[n] for n in sorted(v)] for i, v in got.items()} == plain(rows, 5)


def test_work_for_a_row_hardly_grows_with_the_table():
    """Pivots a row is compared with, and rows of the cells it probes, at n and at 4 n rows."""
    rng = np.random.default_rng(3)
    looked = []
    for n in (4_000, 16_000):
        x = rng.uniform(size=(n, 2)), np.zeros((n, 0))
        pivots = neighbours._Pivots((x[0][: int(n**0.5)], x[1][: int(n**0.5)]))
        cell, radius, top = pivots.place(x)
        reach, top_reach = np.full(len(pivots.points[0]), -np.inf), np.full(len(pivots.members), -np.inf)
        np.maximum.at(reach, cell, radius)
        np.maximum.at(top_reach, pivots.group[cell], top)
        size = np.bincount(cell, minlength=len(reach))
        some = rng.choice(n, 400, replace=False)
        at, near = pivots.near((x[0][some], x[1][some]), np.full(400, 2.5 / n**0.5), reach, top_reach)
        looked.append(size[near].sum() / 400)
    assert looked[1] < 3 * looked[0] and looked[1] < 16_000 / 8
