"""L1 paths and support vector machines of all folds together against plain optima; passes; smoothed sigmoids."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from panelwise.operators import l1path, models, svmpath, tuning


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    rows = []
    for i in range(500):
        x = [rng.gauss(0, 1), rng.gauss(3, 10), float(rng.random() < 0.3), 7.0, rng.gauss(0, 0.01)]
        rows.append((i, float(rng.random() < 1 / (1 + math.exp(-(1.5 * x[0] + 0.1 * (x[1] - 3) - x[2])))), x))
    return rows


@pytest.fixture(scope="module")
def train(spark, data):
    return spark.createDataFrame([(i, y, Vectors.dense(x)) for i, y, x in data], ["row_id", "label", "features"]).repartition(4).cache()


def objective(beta, x, y, penalty):
    z = beta[0] + x @ beta[1:]
    return np.mean(np.logaddexp(0, z) - y * z) + penalty * np.abs(beta[1:]).sum()


def test_fits_are_stationary_and_passes_do_not_grow(train, data):
    folded = tuning.with_folds(train, "row_id", 4, 1)
    penalties = [10 ** (10 - 12 * i / 99) for i in range(100)]
    few, passes_of_few = l1path.fit_paths(folded, penalties[-3:], [-1])
    fits, passes = l1path.fit_paths(folded, penalties, [0, 1, 2, 3, -1])
    assert len(fits) == 500 and passes <= passes_of_few + 4
    fold = {r.row_id: r.fold for r in folded.collect()}
    for f in fits:
        x, y = (np.array(v) for v in zip(*[(x, y) for i, y, x in data if fold[i] != f.fold]))
        sd = x.std(axis=0, ddof=1)
        xs = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
        mu = 1 / (1 + np.exp(-(f.beta[0] + xs @ f.beta[1:])))
        assert l1path.residual_of(np.concatenate([[np.mean(y - mu)], xs.T @ (y - mu) / len(y)]), f.beta, f.penalty) < 1e-6
    assert all(np.array_equal(a.beta.round(7), b.beta.round(7)) for a, b in zip(few, fits[-3:]))


def test_one_penalty_equals_the_library(train):
    ours = models.logistic_l1(train, {"penalty": 0.02})
    theirs = LogisticRegression(elasticNetParam=1.0, regParam=0.02, maxIter=500, tol=1e-12).fit(train)
    assert ours.slopes == pytest.approx(theirs.coefficients.toArray(), abs=2e-4)
    assert ours.intercept == pytest.approx(theirs.intercept, abs=2e-4)


def test_largest_penalty(train):
    top = models.largest_penalty(train)
    assert not models.logistic_l1(train, {"penalty": top * 1.001}).slopes.any() and models.logistic_l1(train, {"penalty": top * 0.99}).slopes.any()


def test_one_class_and_empty_tables(spark, train):
    ones = train.where("label = 1")
    fits, _ = l1path.fit_paths(tuning.with_folds(ones, "row_id", 3), [0.1], [0, -1])
    assert all(f.done and f.beta[0] == np.inf for f in fits)
    assert models.logistic_l1(ones, {"penalty": 0.1})(train).where("p < 0.999").count() == 0
    fits, _ = l1path.fit_paths(tuning.with_folds(train.limit(0), "row_id", 3), [0.1], [0, -1])
    assert all(f.done for f in fits)


def hinge(beta, x, y, cost):
    return 0.5 * beta[1:] @ beta[1:] + cost * np.maximum(0, 1 - (2 * y - 1) * (beta[0] + x @ beta[1:])).sum()


@pytest.mark.parametrize("cost", [0.001, 0.1, 10.0])
def test_machines_are_near_the_optimum(train, data, cost):
    (fit,), _ = svmpath.fit_machines(tuning.with_folds(train, "row_id", 3), [cost], [-1])
    x, y = np.array([r[2] for r in data]), np.array([r[1] for r in data])
    sd = x.std(axis=0, ddof=1)
    xs = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    found = hinge(fit.beta, xs, y, cost)
    rng = np.random.default_rng(1)
    best, beta = found, fit.beta.copy()
    for k in range(4000):  # a random search from there finds next to nothing
        trial = beta + rng.normal(size=6) * 10.0 ** rng.uniform(-5, -0.5)
        value = hinge(trial, xs, y, cost)
        if value < best:
            best, beta = value, trial
    assert found <= best * 1.002


def test_ten_costs_on_ten_folds_take_the_passes_of_the_slowest_fit(train):
    folded = tuning.with_folds(train, "row_id", 10)
    slowest = max(svmpath.fit_machines(folded, [c], [*range(10), -1])[1] for c in (tuning.COSTS[0], tuning.COSTS[-1]))
    tuned = models.svm_cv(train, "row_id")
    assert tuned.passes <= slowest + 5 and len(tuned.results) == 100 and len(tuned.fits) == 110
    assert tuning.mean_accuracy(tuned.results)[tuned.candidates.index(tuned.chosen)] > 0.7


def test_smoothed_sigmoid_equals_plain_newton(spark):
    rng = random.Random(3)
    rows = [(float(rng.random() < 1 / (1 + math.exp(-2 * m))), m) for m in (rng.gauss(0, 1) for _ in range(200))]
    a, b = models.platt_sigmoid(spark.createDataFrame(rows, "label double, margin double"))
    y, z = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mu = 1 / (1 + np.exp(-(a + b * z)))
    assert abs((t - mu).sum()) < 1e-8 and abs(((t - mu) * z).sum()) < 1e-8


def test_sigmoid_of_margins_that_set_classes_apart_is_finite(spark):
    rows = [(float(m > 0), float(m)) for m in range(-10, 11) if m]
    a, b = models.platt_sigmoid(spark.createDataFrame(rows, "label double, margin double"))
    assert math.isfinite(a) and 0 < b < 10


def test_a_pass_adds_up_the_same_sums_in_slices(spark, monkeypatch):
    """Loss, gradient and curvature of several fits a fold, rows taken a few at a time, against plain sums."""
    rng = np.random.default_rng(3)
    x, y, fold = rng.normal(size=(300, 4)) + 2, rng.integers(0, 2, 300), rng.integers(0, 3, 300)
    rows = [(x[i].tolist(), float(y[i]), int(fold[i])) for i in range(300)]
    data = spark.createDataFrame(rows, "x array<double>, label double, fold int")
    fits = [l1path.Fit(k, 0.1, x.mean(axis=0) + k / 9, np.full(4, 1.5), 1.0, rng.normal(size=5)) for k in (-1, 0, 2) for _ in range(3)]
    monkeypatch.setattr(l1path, "PRODUCTS", 100)
    l1path._pass(data, fits)
    for f in fits:
        xs = np.hstack([np.ones((300, 1)), (x - f.mean) / f.sd])[fold != f.fold]
        own, eta = y[fold != f.fold], xs @ f.beta
        mu = 1 / (1 + np.exp(-eta))
        want = np.log1p(np.exp(eta)).sum() - own @ eta, xs.T @ (own - mu), xs.T @ (xs * (mu * (1 - mu))[:, None])
        assert all(np.allclose(a, b, rtol=1e-10, atol=1e-10) for a, b in zip(f.sums, want))
