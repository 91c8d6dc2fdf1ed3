"""Accumulated bootstraps against draws made one by one; slopes against a plain optimum; user statistics."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from panelwise.functions.hashing import mix_seed, mix_step, mix_uniform
from panelwise.operators import replicates, validate

SCORED = "imp int, row_id long, y int, p double"


def uniform(seed, *keys):
    state = mix_seed(seed)
    for i, key in enumerate(keys):
        state = mix_step(state, key, i)
    return mix_uniform(state)


def rows(rng, n, values):
    return [(imp, i, int(rng.random() < 0.4), rng.choice(values)) for i in range(n) for imp in (1, 2) if imp == 1 or i % 3]


def drawn(table, imp, replicate, seed, unit, order=lambda r: (r[3], -r[2])):
    """The rows that a replicate draws, by the two steps of the definition."""
    own = sorted((r for r in table if r[0] == imp), key=order)
    n, units = len(own), -(-len(own) // unit)
    counts = Counter({0: n}) if units == 1 else Counter(
        math.floor(uniform(seed + replicates.UNIT_SEED_STEP, imp, replicate, s) * n) // unit for s in range(1, n + 1))
    out = []
    for k in range(units):
        part = own[k * unit:(k + 1) * unit]
        out += [part[math.floor(uniform(seed, imp, replicate, k, j) * len(part))] for j in range(1, counts[k] + 1)]
    return out


def plain_metrics(rows_):
    n1, n0 = [r[3] for r in rows_ if r[2]], [r[3] for r in rows_ if not r[2]]
    pairs = sum((a > b) + 0.5 * (a == b) for a in n1 for b in n0)
    hits = sum((r[3] >= 0.5) == bool(r[2]) for r in rows_)
    return hits / len(rows_), pairs / (len(n1) * len(n0)) if n1 and n0 else None


@pytest.mark.parametrize(("unit", "values"), [
    (64, [i / 100 for i in range(100)]), (7, [0.2, 0.5, 0.5, 0.5, 0.9]), (1000, [0.3, 0.6]), (5, [0.5])])
def test_exact_replicates_equal_draws_one_by_one(spark, unit, values):
    table = rows(random.Random(unit), 60, values)
    got = validate.bootstrap_metrics(spark.createDataFrame(table, SCORED), ["imp"], "row_id", 35, 5, "exact", unit).collect()
    assert len(got) == 70
    for r in got:
        accuracy, c = plain_metrics(drawn(table, r.imp, r.replicate, 5, unit))
        assert r.accuracy == pytest.approx(accuracy) and (c is None) == (r.c_statistic is None)
        assert c is None or r.c_statistic == pytest.approx(c)


@pytest.mark.parametrize("unit", [5, 64, 1000])
def test_poisson_units_do_not_matter(spark, unit):
    table = rows(random.Random(1), 80, [0.1, 0.4, 0.4, 0.4, 0.7, 0.8])
    df = spark.createDataFrame(table, SCORED)
    got = {(r.imp, r.replicate): r for r in validate.bootstrap_metrics(df, ["imp"], "row_id", 33, 2, "poisson", unit).collect()}
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])
    for (imp, replicate), r in got.items():
        weighted = [x for x in table if x[0] == imp for _ in range(int(np.searchsorted(cdf, uniform(2, imp, replicate, x[1]), "right")))]
        accuracy, c = plain_metrics(weighted)
        assert r.accuracy == pytest.approx(accuracy) and r.c_statistic == pytest.approx(c)
    assert len(got) == 66


def newton(z, n1, n0):
    """Plain logistic optimum by bisection-safe gradient steps on a 2x2 system."""
    a = b = 0.0
    loss = lambda a, b: float((n1 * np.logaddexp(0, -(a + b * z)) + n0 * np.logaddexp(0, a + b * z)).sum())
    for _ in range(200):
        mu = 1 / (1 + np.exp(-(a + b * z)))
        r, v = n1 - (n1 + n0) * mu, (n1 + n0) * mu * (1 - mu)
        d = np.linalg.solve([[v.sum(), (v * z).sum()], [(v * z).sum(), (v * z * z).sum()]], [r.sum(), (r * z).sum()])
        step = 1.0
        while loss(a + step * d[0], b + step * d[1]) > loss(a, b) and step > 1e-12:
            step /= 2
        a, b = a + step * d[0], b + step * d[1]
    return a, b


def test_slope_of_extreme_risks_is_finite(spark):
    table = {1: [(0.0, 2, 30), (0.5, 10, 12), (1.0, 25, 1)], 2: [(0.0, 40, 1), (1.0, 1, 3)], 3: [(0.001, 3, 900), (0.4, 9, 2), (1.0, 1, 700)]}
    got = {r.imp: r for r in validate.calibration_slope(
        spark.createDataFrame([(i, *s) for i, ss in table.items() for s in ss], "imp int, p double, n1 long, n0 long"), ["imp"]).collect()}
    for i, ss in table.items():
        p = np.clip([s[0] for s in ss], 1e-15, 1 - 1e-15)
        a, b = newton(np.log(p / (1 - p)), np.array([s[1] for s in ss]), np.array([s[2] for s in ss]))
        assert got[i].converged and got[i].slope == pytest.approx(b, abs=1e-8) and got[i].intercept == pytest.approx(a, abs=1e-7)


def test_groups_without_a_slope_say_so(spark):
    table = [(1, 0.2, 0, 5), (1, 0.7, 0, 5), (2, 0.2, 0, 5), (2, 0.8, 5, 0), (3, 0.4, 3, 5), (4, 0.0, 0, 9), (4, 0.5, 4, 4), (4, 1.0, 9, 0),
             (5, 0.3, 2, 5), (5, 0.8, 5, 2)]
    got = validate.calibration_slope(spark.createDataFrame(table, "imp int, p double, n1 long, n0 long"), ["imp"]).collect()
    assert {r.imp for r in got if r.converged} == {5} and len(got) == 5
    assert all(r.slope is None and r.intercept is None for r in got if not r.converged)
    none = validate.calibration_slope(spark.createDataFrame([], "imp int, p double, n1 long, n0 long"), ["imp"])
    assert none.collect() == []


def test_replicate_slopes_equal_plain_optima(spark):
    rng = random.Random(9)
    table = [(1, i, int(rng.random() < p), p) for i in range(150) for p in [round(rng.uniform(0.05, 0.95), 2)]]
    got = validate.bootstrap_metrics(spark.createDataFrame(table, SCORED), ["imp"], "row_id", 12, 3, "exact", 40).collect()
    for r in got:
        own = drawn(table, 1, r.replicate, 3, 40)
        z = np.array([math.log(x[3] / (1 - x[3])) for x in own])
        y = np.array([x[2] for x in own])
        assert r.slope == pytest.approx(newton(z, y, 1 - y)[1], abs=1e-8)


def test_report_has_percentiles(spark):
    table = rows(random.Random(2), 120, [i / 50 for i in range(50)])
    df = spark.createDataFrame(table, SCORED)
    wide = validate.bootstrap_metrics(df, ["imp"], "row_id", 40, 1).toPandas()
    report = {r.metric: r for r in validate.validation_report(df, ["imp"], "row_id", 40, 1).collect()}
    assert report["accuracy"].low == pytest.approx(np.quantile(wide["accuracy"], 0.025), abs=1e-6)
    assert report["accuracy"].high == pytest.approx(np.quantile(wide["accuracy"], 0.975), abs=1e-6)
    assert set(report) == set(validate.METRICS) and all(r.low <= r.mean <= r.high for r in report.values())


def test_rows_with_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.7), (1, 2, None, 0.7), (1, 3, 0, None), (None, 4, 1, 0.3), (1, 5, 0, 0.2)], SCORED)
    got = validate.bootstrap_classification(df, ["imp"], "row_id", 3, 1).collect()
    assert len(got) == 3 and {r.accuracy for r in got} == {1.0}
    assert validate.bootstrap_classification(df.limit(0), ["imp"], "row_id", 3, 1).collect() == []


def test_only_sums_are_shuffled(spark):
    """Shuffled rows do not follow rows x replicates: three entries a unit and replicate."""
    df = spark.range(20_000).selectExpr("1 AS imp", "id AS row_id", "int(id % 3 = 0) AS y", "(id * 7919 % 20011) / 20011D AS p")
    made = replicates.work(df, ["imp"], "row_id", 64, 1, "exact", 4096)
    each = replicates.replicate_sums(made, ["imp"], 64, 1)
    assert each.count() == 5 * 3 * 64
    plan = each._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(imp") < plan.index("partial_sum") < plan.index("MapInArrow")


def test_user_statistic_merges_parts(spark):
    table = rows(random.Random(4), 90, [i / 10 for i in range(10)])
    df = spark.createDataFrame(table, SCORED)
    largest = replicates.Statistic(
        ["top", "mean"], lambda c, w: np.array([c["p"][w > 0].max(initial=-1), w @ c["p"], w.sum()]),
        lambda a, b: np.array([max(a[0], b[0]), a[1] + b[1], a[2] + b[2]]), lambda s: [s[0], s[1] / s[2]])
    import hashlib

    key = lambda r: (hashlib.md5(str(r[1]).encode()).hexdigest(), r[1])
    for unit in (4, 1000):
        got = replicates.replicate_statistics(df, ["imp"], "row_id", ["p"], largest, 20, 6, unit).collect()
        assert len(got) == 40
        for r in got:
            p = [x[3] for x in drawn(table, r.imp, r.replicate, 6, unit, key)]
            assert r.top == max(p) and r["mean"] == pytest.approx(sum(p) / len(p))


@pytest.mark.parametrize(("unit", "pack"), [(4, 20), (7, 14), (3, 1000)])
def test_packs_and_blocks_of_draws_do_not_matter(spark, monkeypatch, unit, pack):
    """Small units travel together, each with its own draws."""
    monkeypatch.setattr(replicates, "PACK", pack)
    monkeypatch.setattr(replicates, "BLOCK", 16)
    table = rows(random.Random(unit), 60, [i / 30 for i in range(30)])
    got = validate.bootstrap_classification(spark.createDataFrame(table, SCORED), ["imp"], "row_id", 35, 5, "exact", unit).collect()
    assert len(got) == 70
    for r in got:
        assert r.accuracy == pytest.approx(plain_metrics(drawn(table, r.imp, r.replicate, 5, unit))[0])


def test_small_units_return_no_more_than_large_ones(spark):
    """Neither sums nor counts of draws are made by pairs of units."""
    df = spark.range(20_000).selectExpr("1 AS imp", "id AS row_id", "int(id % 3 = 0) AS y", "(id * 7919 % 20011) / 20011D AS p")
    made = replicates.work(df, ["imp"], "row_id", 64, 1, "exact", 16, None, 4096)
    assert replicates.replicate_sums(made, ["imp"], 64, 1).count() == 5 * 3 * 64
    units = replicates.exact_units(df.selectExpr("imp", "p", "y AS n1", "1 - y AS n0"), ["imp"], 4096)
    assert replicates.unit_counts(units, ["imp"], 64, 1, 16, 4096).count() == 5 * 2


def test_draws_of_few_scores_are_kept_for_the_slopes(spark, monkeypatch):
    """Kept units need no seed any more, those of many scores do; metrics are the same either way."""
    rng = random.Random(4)
    table = spark.createDataFrame(rows(rng, 2400, [0.2, 0.4, 0.7]) + [(3, i, i % 2, rng.random()) for i in range(300)], SCORED)
    units = replicates.counted(replicates.work(table, ["imp"], "row_id", 40, 5, "exact", 1200), ["imp"], 40, 5)
    assert {(r.imp, r.kept is None) for r in units.collect()} == {(1, False), (2, False), (3, True)}
    trial = spark.createDataFrame([(imp, r, 0.1, 0.9) for imp in (1, 2, 3) for r in (1, 2, 33, 40)], "imp int, replicate int, a double, b double")
    sums = [sorted(map(tuple, replicates.slope_sums(units, ["imp"], seed)(trial).collect())) for seed in (5, 6)]
    assert [a == b for a, b in zip(*sums)] == [True] * 8 + [False] * 4
    made = []
    for places in (replicates.KEPT, 10 ** 9):
        monkeypatch.setattr(replicates, "KEPT", places)
        made.append(sorted(map(tuple, validate.bootstrap_metrics(table, ["imp"], "row_id", 40, 5, "exact", 1200).collect())))
    assert made[0] == [pytest.approx(r) for r in made[1]]


def test_draws_are_numbered_once_for_all_replicates(monkeypatch):
    """Numbers of a unit's draws are not made anew for each replicate; draws are those of the definition."""
    made = []
    monkeypatch.setattr(replicates, "_slots", lambda first, last, plain=replicates._slots: made.append(last - first) or plain(first, last))
    for r in range(1, 101):
        state = replicates._state(5, [1, r])
        got = replicates._drawn(state, 2, 3, 4096, 1000, np.array([900 + r]))
        want = Counter(math.floor(uniform(5, 1, r, 3, j) * 1000) for j in range(1, 901 + r)) if r % 25 == 0 else None
        assert got.sum() == 900 + r and (want is None or {k: int(n) for k, n in enumerate(got) if n} == dict(want))
    assert sum(made) <= 2 * replicates.UNIT
    long = replicates._drawn(state, 2, 3, 10 ** 6, 1000, np.array([2 * replicates.UNIT + 5]))
    assert long.sum() == 2 * replicates.UNIT + 5


@pytest.mark.parametrize("n", [65_537, 899_999, 54_000_000, 10 ** 10 + 7])
def test_units_of_a_power_of_two_need_no_division(n):
    from panelwise.functions.hashing import mix_picks

    bits = np.concatenate([np.random.default_rng(1).integers(0, 1 << 32, 200_000), [0, (1 << 32) - 1]]).astype(np.uint32)
    assert (mix_picks(bits, n / replicates.UNIT) == mix_picks(bits, n) // replicates.UNIT).all()


def test_rows_carry_few_draws_however_many_units_a_pack_has(spark, monkeypatch):
    """Of a long run in small units a row brings the draws of as many chunks as stay below the bound, not of all replicates."""
    monkeypatch.setattr(replicates, "CARRIED", 1 << 16)
    monkeypatch.setattr(replicates, "_tasks", lambda df: 1)
    scored = spark.range(6000).selectExpr("1 AS imp", "id AS row_id", "id / 6000 AS p", "cast(id % 3 = 0 AS int) AS y")
    made = replicates.work(scored, ["imp"], "row_id", 320, 3, "exact", 8, None, 1024)
    sizes = made.selectExpr("aggregate(draws, 0, (n, d) -> n + length(d.part)) AS n", "chunks").collect()
    assert {r.chunks for r in sizes} == {4} and max(r.n for r in sizes) <= 1 << 16 and len(sizes) == 6 * 3
