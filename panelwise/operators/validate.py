"""Validation of predicted risks.

Everything starts from a score table: one row per run (or run and replicate) and
distinct score, with the number of events ``n1`` and non-events ``n0``. Equal scores
are merged before anything is shuffled, joined or sorted, and one resample serves
every metric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.expr import as_col
from panelwise.operators import replicates as replicates_
from panelwise.operators.grouping import running_sums, value_cuts
from panelwise.operators.replicates import SMALLEST_P, damped_newton, outcome_sums
from panelwise.operators.sampling import check_method
from panelwise.session import cut_lineage

CUT = 0.5
#: Shares below which the ends of a percentile interval lie.
INTERVAL = (0.025, 0.975)
Z_95 = 1.959963984540054
DECILES = 10
GRID = 20
METRICS = [
    "accuracy", "balanced_accuracy", "precision", "sensitivity", "specificity", "npv",
    "c_statistic", "r2", "slope",
]


def classify(p: str = "p", cut: float = CUT) -> Column:
    return (as_col(p) >= F.lit(cut)).cast("int")


def score_table(scored: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """(by, p, n1, n0) from rows with ``y`` in 0/1 and a risk ``p``."""
    w = F.lit(1).cast("long") if weight is None else weight
    y = F.col("y").cast("long")
    return scored.groupBy(*by, "p").agg(F.sum(w * y).alias("n1"), F.sum(w * (1 - y)).alias("n0"))


def confusion_matrix(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Four counts at the cut, positive class 1."""
    up = F.col("p") >= F.lit(CUT)

    def total(keep: Column, n: str) -> Column:
        return F.coalesce(F.sum(F.when(keep, F.col(n))), F.lit(0))

    return scores.groupBy(*by).agg(
        total(up, "n1").alias("tp"), total(up, "n0").alias("fp"),
        total(~up, "n0").alias("tn"), total(~up, "n1").alias("fn"),
    )


def _share(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def classification_metrics(confusion: DataFrame, by: Sequence[str]) -> DataFrame:
    """Six rates from the counts; a rate without a denominator is NULL."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    sens, spec = _share(tp, tp + fn), _share(tn, tn + fp)
    return confusion.select(
        *by, _share(tp + tn, tp + fp + tn + fn).alias("accuracy"), ((sens + spec) / 2).alias("balanced_accuracy"),
        _share(tp, tp + fp).alias("precision"), sens.alias("sensitivity"), spec.alias("specificity"),
        _share(tn, tn + fn).alias("npv"),
    )


def c_statistic(scores: DataFrame, by: Sequence[str], cuts: Sequence[float] | None = None) -> DataFrame:
    """Probability that an event scores above a non-event, ties counting half."""
    ranked = running_sums(scores, by, "p", ["n0"], cuts=cuts, totals=False)
    below = F.col("cum_n0") - F.col("n0") / 2
    return ranked.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("n1") * below), F.sum("n1").cast("double") * F.sum("n0")).alias("c_statistic")
    )


def _clamped() -> Column:
    return F.least(F.greatest(F.col("p"), F.lit(SMALLEST_P)), F.lit(1 - SMALLEST_P))


def _explained(e: Column, o: Column, loglik: Column) -> Column:
    """Explained variation of risks with this log likelihood, against the rate of e events and o non-events alone."""
    n = e + o
    d0 = F.when((e > 0) & (o > 0), -2 * (e * F.log(e / n) + o * F.log(o / n)))
    return (1 - F.exp((-2 * loglik - d0) / n)) / (1 - F.exp(-d0 / n))


def nagelkerke_r2(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Explained variation of the risks as they are, against the event rate alone."""
    p = _clamped()
    d = scores.groupBy(*by).agg(
        F.sum("n1").cast("double").alias("_e"), F.sum("n0").cast("double").alias("_o"),
        F.sum(F.col("n1") * F.log(p) + F.col("n0") * F.log(1 - p)).alias("_l"),
    )
    return d.select(*by, _explained(F.col("_e"), F.col("_o"), F.col("_l")).alias("r2"))


def calibration_slope(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, intercept, slope, converged) of the outcome on logit(p), all groups at once, by damped Newton steps.

    A round is one aggregate of six sums a group. Groups whose outcomes are all alike, or set apart by the score, or that have one
    score only, have no slope: it is NULL and ``converged`` false.
    """
    start = scores.groupBy(*by).agg(F.sum(F.col("n1") + F.col("n0")).alias("n"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    p = f"least(greatest(p, {SMALLEST_P}D), 1D - {SMALLEST_P}D)"
    d = cut_lineage(scores.selectExpr(*by, f"ln({p} / (1 - {p})) AS z", "n1", "n0"))
    return damped_newton(start, by, "n", outcome_sums(d, by))


def recalibrated(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scores with p moved to the outcome's logistic model on logit(p); groups without such a model keep theirs."""
    z = F.log(_clamped() / (1 - _clamped()))
    d = scores.join(calibration_slope(scores, by), list(by), "left")
    moved = 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * z)))
    return d.select(*by, F.coalesce(moved, F.col("p")).alias("p"), "n1", "n0").groupBy(*by, "p").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def bootstrap_totals(
    scored: DataFrame, by: Sequence[str] = ("imp",), row_id: str = "row_id",
    replicates: int = 1000, seed: int = 1, method: str = "exact", unit: int = replicates_.UNIT, again: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Counts and sums per run and replicate, and the units they were made from. Draws stay inside tasks; only sums are shuffled.

    ``again`` keeps the draws of units with few scores, for those who need them more than once."""
    check_method(method)
    cuts = value_cuts(scored.select(*by, "p").distinct(), "p")
    units = replicates_.work(scored, by, row_id, replicates, seed, method, unit, cuts, replicates_.PACK)
    if again:
        units = replicates_.counted(units, by, replicates, seed)
    return replicates_.totals(replicates_.replicate_sums(units, by, replicates, seed, CUT), by), units


def bootstrap_classification(
    scored: DataFrame, by: Sequence[str] = ("imp",), row_id: str = "row_id",
    replicates: int = 1000, seed: int = 1, method: str = "exact", unit: int = replicates_.UNIT,
) -> DataFrame:
    """The six rates per run and replicate."""
    sums, _ = bootstrap_totals(scored, by, row_id, replicates, seed, method, unit)
    return classification_metrics(sums, [*by, "replicate"])


def bootstrap_metrics(
    scored: DataFrame, by: Sequence[str] = ("imp",), row_id: str = "row_id",
    replicates: int = 1000, seed: int = 1, method: str = "exact", unit: int = replicates_.UNIT,
) -> DataFrame:
    """Nine metrics per run and replicate, from one resample.

    Slopes start from the run's own one, so that two or three rounds are enough; the draws of units with few scores are kept for them
    as counts by score, others are made anew in each.
    """
    keys = [*by, "replicate"]
    sums, units = bootstrap_totals(scored, by, row_id, replicates, seed, method, unit, again=True)
    sums = cut_lineage(sums)
    own = calibration_slope(score_table(scored.dropna(subset=[*by, "p", "y"]), by), by)
    start = sums.join(own, list(by), "left").select(
        *keys, (F.col("n1") + F.col("n0")).alias("n"), F.coalesce("intercept", F.lit(0.0)).alias("a"), F.coalesce("slope", F.lit(0.0)).alias("b"))
    slopes = damped_newton(start, keys, "n", replicates_.slope_sums(units, by, seed))
    e, o = F.col("n1").cast("double"), F.col("n0").cast("double")
    more = sums.select(*keys, F.try_divide(F.col("concordant"), e * o).alias("c_statistic"), _explained(e, o, F.col("loglik")).alias("r2"))
    return classification_metrics(sums, keys).join(more, keys).join(slopes.select(*keys, "slope"), keys, "left")


def long_metrics(wide: DataFrame, keep: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    return wide.select(*keep, F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, value)"))


def metric_summary(long: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Mean and sd per metric over all runs and replicates, and the interval that holds the middle 95 % of them; NULLs ignored."""
    low, high = (F.percentile("value", share) for share in INTERVAL)
    return long.groupBy(*by, "metric").agg(
        F.round(F.avg("value"), digits).alias("mean"), F.round(F.stddev_samp("value"), digits).alias("sd"),
        F.round(low, digits).alias("low"), F.round(high, digits).alias("high"), F.count("value").alias("n"),
    )


def validation_report(
    scored: DataFrame, by: Sequence[str] = ("imp",), row_id: str = "row_id",
    replicates: int = 1000, seed: int = 1, method: str = "exact", unit: int = replicates_.UNIT,
) -> DataFrame:
    """Mean, sd and 95 % percentile interval of the nine metrics over all runs and replicates."""
    return metric_summary(long_metrics(bootstrap_metrics(scored, by, row_id, replicates, seed, method, unit), by))


def roc_curve(scores: DataFrame, by: Sequence[str], cuts: Sequence[float] | None = None) -> DataFrame:
    """(by, threshold, tpr, fpr) for every distinct score, and the origin (NULL threshold)."""
    r = running_sums(scores, by, "p", ["n1", "n0"], descending=True, cuts=cuts)
    points = r.select(
        *by, F.col("p").alias("threshold"), _share(F.col("cum_n1"), F.col("tot_n1")).alias("tpr"),
        _share(F.col("cum_n0"), F.col("tot_n0")).alias("fpr"),
    )
    origin = scores.groupBy(*by).agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")
    )
    return points.unionByName(origin)


def roc_average(roc: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over runs of the best true positive rate within each false positive rate of a grid."""
    cell = F.ceil(F.round(F.col("fpr") * GRID, 9)).cast("int")
    best = roc.withColumn("_cell", cell).groupBy(*by, "_cell").agg(F.max("tpr").alias("tpr"))
    upward = best.select(*by, "tpr", F.explode(F.sequence(F.col("_cell"), F.lit(GRID))).alias("_cell"))
    run = upward.groupBy(*by, "_cell").agg(F.max("tpr").alias("tpr"))
    return run.groupBy("_cell").agg(
        F.avg("tpr").alias("mean_tpr"), F.stddev_samp("tpr").alias("sd_tpr")
    ).select((F.col("_cell") / GRID).alias("fpr"), "mean_tpr", "sd_tpr")


def calibration_table(scores: DataFrame, by: Sequence[str], cuts: Sequence[float] | None = None) -> DataFrame:
    """Predicted against observed risk by tenth of the score, with a Wilson interval.

    Equal scores stay in one tenth, the one their lowest rank falls in.
    """
    d = scores.withColumn("n", F.col("n1") + F.col("n0"))
    r = running_sums(d, by, "p", ["n"], cuts=cuts)
    tenth = F.floor(F.lit(DECILES) * (F.col("cum_n") - F.col("n")) / F.col("tot_n")) + 1
    t = r.withColumn("decile", tenth.cast("int")).groupBy(*by, "decile").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("_p"), F.sum("n1").alias("_e")
    )
    n, zz = F.col("n"), Z_95 * Z_95
    rate = F.col("_e") / n
    mid = (rate + zz / (2 * n)) / (1 + zz / n)
    half = Z_95 * F.sqrt(rate * (1 - rate) / n + zz / (4 * n * n)) / (1 + zz / n)
    return t.select(
        *by, "decile", "n", (F.col("_p") / n).alias("mean_p"), rate.alias("observed"),
        (mid - half).alias("low"), (mid + half).alias("high"),
    )
