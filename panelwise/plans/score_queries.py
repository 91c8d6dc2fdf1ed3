"""Registered queries: splits, bootstrap and validation metrics on the deterministic score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.functions.hashing import hash_uniform
from panelwise.operators import replicates, sampling, validate
from panelwise.operators.grouping import value_cuts
from panelwise.plans.views import scored

RUN = ["imp"]
REPLICATES = 1000
SEED = 7


def _rounded(df: DataFrame, keep: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in df.columns if c not in keep])


def _scores(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    t = validate.score_table(scored(spark, d), RUN)
    return t, value_cuts(t, "p")


def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    s = sampling.train_test_split(scored(spark, d), "row_id", (0.7, 0.3), 100)
    return s.select("row_id", "imp", "is_train")


def train_test_split_per_run(spark: SparkSession, d: str) -> DataFrame:
    s = sampling.train_test_split(scored(spark, d), "row_id", (0.8, 0.2), 100, run="imp")
    return s.groupBy("imp", "is_train").agg(F.count(F.lit(1)).alias("n"))


def bootstrap_weights(spark: SparkSession, d: str) -> DataFrame:
    return sampling.bootstrap_weights(scored(spark, d), RUN, "row_id", 10, SEED, "exact")


def bootstrap_weights_poisson(spark: SparkSession, d: str) -> DataFrame:
    return sampling.bootstrap_weights(scored(spark, d), RUN, "row_id", 10, SEED, "poisson")


def classify_threshold(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("row_id", "imp", "y", validate.classify().alias("predicted"))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return validate.confusion_matrix(validate.score_table(scored(spark, d), RUN), RUN)


def bootstrap_classification(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(validate.bootstrap_classification(scored(spark, d), RUN, "row_id", REPLICATES, SEED, "exact"), [*RUN, "replicate"])


def c_statistic(spark: SparkSession, d: str) -> DataFrame:
    s, cuts = _scores(spark, d)
    return _rounded(validate.c_statistic(s, RUN, cuts), RUN)


def nagelkerke_r2(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(validate.nagelkerke_r2(validate.score_table(scored(spark, d), RUN), RUN), RUN)


def calibration_slope(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(validate.calibration_slope(validate.score_table(scored(spark, d), RUN), RUN), [*RUN, "converged"])


def extreme(spark: SparkSession, d: str) -> DataFrame:
    """The scored rows with risks of 0, a half and 1 only, not all of them right."""
    noisy = F.col("p") + hash_uniform(12, "row_id") - 0.5
    return scored(spark, d).withColumn("p", F.when(noisy < 0.25, 0.0).when(noisy < 0.75, 0.5).otherwise(1.0))


def calibration_slope_extremes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(validate.calibration_slope(validate.score_table(extreme(spark, d), RUN), RUN), [*RUN, "converged"])


def recalibrated_r2(spark: SparkSession, d: str) -> DataFrame:
    scores = validate.score_table(scored(spark, d), RUN)
    return _rounded(validate.nagelkerke_r2(validate.recalibrated(scores, RUN), RUN), RUN)


def scored_finely(spark: SparkSession, d: str) -> DataFrame:
    """The scored rows with risks of their own: few of them are equal."""
    return scored(spark, d).withColumn("p", F.round(F.col("p") + 0.001 * hash_uniform(11, "row_id"), 9))


def validation_report_continuous(spark: SparkSession, d: str) -> DataFrame:
    """Scores without ties, cut into small units of draws."""
    return validate.validation_report(scored_finely(spark, d), RUN, "row_id", REPLICATES, SEED, "exact", unit=128)


def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    s, cuts = _scores(spark, d)
    return _rounded(validate.roc_curve(s, RUN, cuts), [*RUN, "threshold"])


def roc_average(spark: SparkSession, d: str) -> DataFrame:
    s, cuts = _scores(spark, d)
    return _rounded(validate.roc_average(validate.roc_curve(s, RUN, cuts), RUN), [])


def calibration_table(spark: SparkSession, d: str) -> DataFrame:
    s, cuts = _scores(spark, d)
    return _rounded(validate.calibration_table(s, RUN, cuts), [*RUN, "decile", "n"])


def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return validate.validation_report(scored(spark, d), RUN, "row_id", REPLICATES, SEED, "exact")


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sd of the rates over runs, on Poisson resamples."""
    wide = validate.bootstrap_classification(scored(spark, d), RUN, "row_id", REPLICATES, SEED, "poisson")
    return validate.metric_summary(validate.long_metrics(wide, [*RUN, "replicate"], validate.METRICS[:6]))


def exact_mean(value: Column) -> Column:
    """Mean of values with six decimals at most, rounded to six: in whole numbers, so that no order of summing shows."""
    total, n = F.sum(F.round(value * 1_000_000).cast("long")), F.count(value)
    return F.floor((2 * total + n) / (2 * n)) / 1_000_000


def _millionths(total: float, n: float) -> float | None:
    return (2 * int(total) + int(n)) // (2 * int(n)) / 1_000_000 if n else None


def bootstrap_custom(spark: SparkSession, d: str) -> DataFrame:
    """Weighted means, as a user's statistic: sums in whole millionths and the number of draws."""
    names = ["mean_risk", "event_rate", "brier"]
    values = {"mean_risk": F.col("p"), "event_rate": F.col("y"), "brier": (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))}
    rows = scored(spark, d).select("imp", "row_id", *[F.round(v * 1_000_000).cast("long").alias(n) for n, v in values.items()])
    means = replicates.Statistic(
        names, lambda rows, w: np.array([*(w @ rows[n] for n in names), w.sum()]), np.add,
        lambda s: [_millionths(t, s[-1]) for t in s[:-1]])
    return replicates.replicate_statistics(rows, RUN, "row_id", names, means, REPLICATES, SEED)


def bootstrap_trimmed_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean risk without the lowest and the highest tenth of the draws: no aggregate of SQL, its state is how often each risk is drawn."""

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.concatenate([a.reshape(-1, 2), b.reshape(-1, 2)])
        values, at = np.unique(both[:, 0], return_inverse=True)
        return np.column_stack([values, np.bincount(at, both[:, 1])]).ravel()

    def finish(state: np.ndarray) -> list[float | None]:
        values, n = state.reshape(-1, 2).T
        upto, total = np.cumsum(n), n.sum()
        out = total // 10
        left = np.clip(np.minimum(upto, total - out) - np.maximum(upto - n, out), 0, None)
        return [_millionths(float(values @ left), float(left.sum()))]

    rows = scored(spark, d).select("imp", "row_id", F.round(F.col("p") * 1_000_000).cast("long").alias("p"))
    trimmed = replicates.Statistic(
        ["trimmed_mean"], lambda rows, w: merge(np.column_stack([rows["p"], w])[w > 0].ravel(), np.empty(0)), merge, finish)
    return replicates.replicate_statistics(rows, RUN, "row_id", ["p"], trimmed, REPLICATES, SEED, unit=128)


QUERIES = {
    f.__name__: f
    for f in (
        train_test_split, train_test_split_per_run, bootstrap_weights, bootstrap_weights_poisson, classify_threshold,
        confusion_matrix, bootstrap_classification, c_statistic, nagelkerke_r2, calibration_slope, roc_curve,
        roc_average, calibration_table, validation_report, metric_summary, bootstrap_custom,
        bootstrap_trimmed_mean, calibration_slope_extremes, recalibrated_r2, validation_report_continuous,
    )
}
