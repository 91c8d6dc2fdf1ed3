"""Classifiers on (row id, label, features): fits return a scorer that adds the risk ``p``."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.operators import l1path, svmpath
from panelwise.operators.l1path import largest_penalty  # noqa: F401
from panelwise.operators.replicates import damped_newton, outcome_sums
from panelwise.operators.tuning import COSTS, PENALTIES, Scorer, best_candidate, cross_validate, with_folds
from panelwise.session import cut_lineage

PLATT_FOLDS = 5


def _risk(model) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(df)
        return scored.select(*df.columns, vector_to_array("probability")[1].alias("p"))

    score.model = model
    return score


def logistic_l1(train: DataFrame, params: Mapping[str, Any]) -> Scorer:
    """The fit of one penalty on all rows."""
    (fit,), _ = l1path.fit_paths(train.withColumn("fold", F.lit(0)), [float(params["penalty"])])
    b = fit.coefficients()
    return linear_risk(b[0], b[1:])


@dataclass
class Tuned:
    """A chosen candidate, its final fit, and the search behind it."""

    scorer: Scorer
    chosen: Mapping[str, Any]
    candidates: Sequence[Mapping[str, Any]]
    results: Sequence[Mapping[str, Any]]
    fits: Sequence[Any] = ()
    passes: int = 0


def linear_risk(intercept: float, slopes: Sequence[float]) -> Scorer:
    """Scores by a logistic model with these coefficients."""
    b0, b = float(intercept), np.array(slopes, float)

    def risk(x: pd.Series) -> pd.Series:
        z = np.clip(b0 + np.stack(x.to_numpy()) @ b, -700, 700) if len(x) else np.empty(0)
        return pd.Series(1 / (1 + np.exp(-z)))

    udf = F.pandas_udf(risk, "double")

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("p", udf(vector_to_array("features")))

    score.intercept, score.slopes = b0, b
    return score


def lasso_cv(
    train: DataFrame, row_id: str, penalties: Sequence[float] = PENALTIES, folds: int = 10, seed: int = 1
) -> Tuned:
    """L1 path by cross-validated misclassification; the largest penalty wins ties.

    All penalties and folds, and the fits on all rows, are worked out together: the passes over the data are those of some Newton steps.
    ``fits`` of the result are those by fold, then the ones on all rows.
    """
    folded = with_folds(train, row_id, folds, seed)
    ordered = sorted(penalties, reverse=True)
    fits, passes = l1path.fit_paths(folded, ordered, [*range(folds), -1])
    inside, whole = fits[: -len(ordered)], fits[-len(ordered) :]
    candidates = [{"penalty": v} for v in ordered]
    results = [
        {"candidate": i % len(ordered), "fold": f.fold, "accuracy": right / n if n else None, "n": n}
        for i, (f, (right, n)) in enumerate(zip(inside, l1path.hits(folded, inside)))
    ]
    chosen = best_candidate(results)
    b = whole[chosen].coefficients()
    return Tuned(linear_risk(b[0], b[1:]), candidates[chosen], candidates, results, fits, passes)


def coefficients(scorer: Scorer, features: Sequence[str], spark) -> DataFrame:
    """(feature, coef), the intercept among them: one row per predictor."""
    rows = [("(Intercept)", scorer.intercept), *zip(features, map(float, scorer.slopes))]
    return spark.createDataFrame(rows, "feature string, coef double")


def linear_margin(intercept: float, slopes: Sequence[float]) -> Column:
    """The margin of ``features`` under these coefficients."""
    b0, b = float(intercept), np.array(slopes, float)

    def margin(x: pd.Series) -> pd.Series:
        return pd.Series(b0 + np.stack(x.to_numpy()) @ b if len(x) else np.empty(0))

    return F.pandas_udf(margin, "double")(vector_to_array("features"))


def _machine(fit: svmpath.Machine) -> Scorer:
    b = fit.coefficients()

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("margin", linear_margin(b[0], b[1:])).withColumn("p", (F.col("margin") >= 0).cast("double"))

    score.intercept, score.slopes = b[0], b[1:]
    return score


def linear_svm(train: DataFrame, params: Mapping[str, Any]) -> Scorer:
    """Linear SVM of a given cost; p is the class, 0 or 1."""
    (fit,), _ = svmpath.fit_machines(train.withColumn("fold", F.lit(0)), [float(params["cost"])])
    return _machine(fit)


def svm_cv(train: DataFrame, row_id: str, costs: Sequence[float] = COSTS, folds: int = 10, seed: int = 1) -> Tuned:
    """Costs by cross-validated accuracy, the first listed on ties: all costs and folds, and the fits on all rows, are worked out together."""
    folded = with_folds(train, row_id, folds, seed)
    fits, passes = svmpath.fit_machines(folded, costs, [*range(folds), -1])
    inside, whole = fits[: -len(costs)], fits[-len(costs) :]
    results = [
        {"candidate": i % len(costs), "fold": f.fold, "accuracy": right / n if n else None, "n": n}
        for i, (f, (right, n)) in enumerate(zip(inside, l1path.hits(folded, inside)))
    ]
    candidates = [{"cost": c} for c in costs]
    chosen = best_candidate(results)
    return Tuned(_machine(whole[chosen]), candidates[chosen], candidates, results, fits, passes)


def platt_sigmoid(margins: DataFrame) -> tuple[float, float]:
    """(intercept, slope) of the probability of label 1 by margin, from (label, margin).

    Labels are smoothed: an event counts as (n1 + 1) / (n1 + 2) of one, a non-event as 1 / (n0 + 2). Without a finite optimum the
    probability is that of the smoothed labels at any margin.
    """
    n1, n = margins.agg(F.sum("label"), F.count(F.lit(1))).first()
    n1 = n1 or 0.0
    high, low = (n1 + 1) / (n1 + 2), 1 / (n - n1 + 2)
    target = F.when(F.col("label") == 1, F.lit(high)).otherwise(F.lit(low))
    d = cut_lineage(margins.select(F.lit(1).alias("k"), F.col("margin").alias("z"), target.alias("n1"), (1 - target).alias("n0")))
    start = margins.sparkSession.createDataFrame([(1, float(n), 0.0, 0.0)], "k int, n double, a double, b double")
    fit = damped_newton(start, ["k"], "n", outcome_sums(d, ["k"])).first()
    if fit["converged"]:
        return fit["intercept"], fit["slope"]
    rate = (n1 * high + (n - n1) * low) / n if n else 0.5
    return math.log(rate / (1 - rate)), 0.0


def platt_svm(train: DataFrame, row_id: str, cost: float, folds: int = PLATT_FOLDS, seed: int = 1) -> Scorer:
    """Linear SVM with a sigmoid from margin to probability, fitted on out-of-fold margins; all fits are worked out together."""
    folded = with_folds(train, row_id, folds, seed)
    fits, _ = svmpath.fit_machines(folded, [cost], [*range(folds), -1])
    outside = reduce(DataFrame.unionByName, [
        _machine(f)(folded.where(F.col("fold") == f.fold)).select("label", "margin") for f in fits[:-1]])
    a, b = platt_sigmoid(outside)
    machine = _machine(fits[-1])

    def score(df: DataFrame) -> DataFrame:
        z = F.lit(a) + F.lit(b) * F.col("margin")
        return machine(df).withColumn("p", 1 / (1 + F.exp(-z)))

    score.sigmoid = a, b
    return score


def boosted_trees(train: DataFrame, params: Mapping[str, Any], seed: int = 1) -> Scorer:
    """Gradient-boosted trees with logistic loss."""
    gbt = GBTClassifier(
        maxIter=int(params["nrounds"]), maxDepth=int(params["max_depth"]), stepSize=max(float(params["eta"]), 1e-3),
        minInfoGain=float(params.get("gamma", 0.0)) / max(1, train.count()),
        subsamplingRate=float(params.get("subsample", 1.0)),
        minInstancesPerNode=max(1, int(params.get("min_child_weight", 1))), seed=seed,
    )
    return _risk(gbt.fit(train))


def tune(
    train: DataFrame, row_id: str, candidates: Sequence[Mapping[str, Any]], fit, folds: int = 10, seed: int = 1
) -> Tuned:
    """Cross-validate the candidates, then fit the best on all rows."""
    results = cross_validate(with_folds(train, row_id, folds, seed), candidates, fit, folds)
    chosen = candidates[best_candidate(results)]
    return Tuned(fit(train, chosen), chosen, candidates, results)
