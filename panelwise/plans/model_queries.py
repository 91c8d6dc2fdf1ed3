"""Registered queries: model fits, searches, scores, attributions and their comparison.

Sizes are the operators' defaults (100 penalties, 10 candidates, 10 folds, 100 steps, 1000 replicates) but for the tree search: see README.
Models themselves are beyond SQL; ``*_check`` queries state what must hold of them, row by row, for SQL to compare.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.operators import attribution, impute, models, network, profile, validate
from panelwise.operators.tuning import RANDOM_NETWORK, RANDOM_TREES, random_candidates, results_table
from panelwise.plans.train_queries import CATEGORICAL, NUMERIC
from panelwise.plans.views import scored, train_missing, train_table
from panelwise.plans.workflow import Design, design, score_runs
from panelwise.session import cut_lineage

TREES = {"nrounds": 10, "max_depth": 3, "eta": 0.3}
REPLICATES = 1000
#: The tree search: fewer candidates, folds and rounds than its defaults.
TREE_FOLDS, TREE_CANDIDATES = 2, 3


def prepared(spark: SparkSession, d: str, balance: bool = False) -> Design:
    return design(train_table(spark, d), "y", "row_id", NUMERIC, CATEGORICAL, balance=balance)


def _risks(scored: DataFrame) -> DataFrame:
    return scored.select("row_id", F.col("label").cast("int").alias("y"), F.round("p", 6).alias("p"))


def lasso_cv(spark: SparkSession, d: str) -> DataFrame:
    data = prepared(spark, d)
    tuned = models.lasso_cv(data.train, "row_id")
    return results_table(data.train, tuned.results, tuned.candidates)


def lasso_path_check(spark: SparkSession, d: str) -> DataFrame:
    """Of every penalty and fold (-1: all rows) the rows fitted, and whether the fit meets the conditions of an optimum to 1e-6."""
    tuned = models.lasso_cv(prepared(spark, d).train, "row_id")
    place = {c["penalty"]: i for i, c in enumerate(tuned.candidates)}
    rows = [(place[f.penalty], f.fold, int(f.n), bool(f.residual < 1e-6)) for f in tuned.fits]
    return spark.createDataFrame(rows, "candidate int, fold int, n long, stationary boolean")


def searched_lasso(data: Design) -> models.Tuned:
    return models.lasso_cv(data.train, "row_id")


def lasso_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients at the searched penalty."""
    data = prepared(spark, d)
    return models.coefficients(searched_lasso(data).scorer, data.features, spark)


def lasso_coefficient_runs(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of ten imputed runs, each at its own searched penalty, side by side with their mean and sd."""
    runs = list(range(1, 11))
    filled = cut_lineage(impute.sample_impute(train_missing(spark, d), "row_id", ["fa", "bmi", "education"], {i: 100 * i for i in runs}))
    parts = []
    for i in runs:
        data = design(filled.where(F.col("imp") == i), "y", "row_id", NUMERIC, CATEGORICAL, balance=False)
        parts.append(models.coefficients(searched_lasso(data).scorer, data.features, spark).withColumn("imp", F.lit(i)))
    long = cut_lineage(reduce(DataFrame.unionByName, parts))
    wide = long.groupBy("feature").pivot("imp", runs).agg(F.first("coef"))
    wide = wide.select("feature", *[F.round(str(i), 6).alias(f"run_{i}") for i in runs])
    return wide.join(profile.summarise(long, "feature", "coef"), "feature")


def score(spark: SparkSession, d: str) -> DataFrame:
    data = prepared(spark, d, balance=True)
    return _risks(searched_lasso(data).scorer(data.test))


def mlp_train(spark: SparkSession, d: str) -> DataFrame:
    data = prepared(spark, d)
    return _risks(network.fit_network(data.train, {"size": 3, "decay": 0.1})(data.test))


def random_search_cv(spark: SparkSession, d: str) -> DataFrame:
    data = prepared(spark, d)
    tuned = network.tune_network(data.train, "row_id", random_candidates(RANDOM_NETWORK))
    return results_table(data.train, tuned.results, tuned.candidates)


def linear_svm(spark: SparkSession, d: str) -> DataFrame:
    data = prepared(spark, d)
    return models.linear_svm(data.train, {"cost": 0.1})(data.test).select("row_id", "label", F.round("margin", 4).alias("margin"))


def platt_scaling(spark: SparkSession, d: str) -> DataFrame:
    data = prepared(spark, d)
    return _risks(models.platt_svm(data.train, "row_id", 0.1)(data.test))


def grid_search_cv(spark: SparkSession, d: str) -> DataFrame:
    data = prepared(spark, d)
    tuned = models.svm_cv(data.train, "row_id")
    return results_table(data.train, tuned.results, tuned.candidates)


def grid_search_check(spark: SparkSession, d: str) -> DataFrame:
    """Of every cost and fold the rows kept out, and whether some accuracy was found."""
    tuned = models.svm_cv(prepared(spark, d).train, "row_id")
    rows = [(r["candidate"], r["fold"], r["n"], r["accuracy"] is not None and 0 <= r["accuracy"] <= 1) for r in tuned.results]
    return spark.createDataFrame(rows, "candidate int, fold int, n long, scored boolean")


def gbt_train(spark: SparkSession, d: str) -> DataFrame:
    data = prepared(spark, d)
    return _risks(models.boosted_trees(data.train, TREES)(data.test))


def gbt_search_cv(spark: SparkSession, d: str) -> DataFrame:
    data = prepared(spark, d)
    ranges = {**RANDOM_TREES, "nrounds": ("int", 1, 8), "max_depth": ("int", 1, 4)}
    tuned = models.tune(data.train, "row_id", random_candidates(ranges, TREE_CANDIDATES), models.boosted_trees, TREE_FOLDS)
    return results_table(data.train, tuned.results, tuned.candidates)


def shap_values(spark: SparkSession, d: str) -> DataFrame:
    data = prepared(spark, d)
    fit = models.boosted_trees(data.train, TREES)
    return attribution.shap_values(data.test, "row_id", fit.model, data.features)


def shap_additivity(spark: SparkSession, d: str) -> DataFrame:
    """Of every row whether its attributions and the base add up to the margin."""
    data = prepared(spark, d)
    fit = models.boosted_trees(data.train, TREES)
    base = attribution.base_value(attribution.trees_of(fit.model, spark))
    sums = attribution.shap_values(data.test, "row_id", fit.model, data.features).groupBy("row_id").agg(F.sum("shap").alias("s"), F.count("*").alias("n"))
    margin = fit(data.test).select("row_id", F.log(F.col("p") / (1 - F.col("p"))).alias("margin"))
    off = F.abs(F.col("s") + F.lit(base) - F.col("margin"))
    return sums.join(margin, "row_id").select("row_id", "n", (off < 1e-6).alias("additive"))


def shap_summary(spark: SparkSession, d: str) -> DataFrame:
    return attribution.shap_summary(shap_values(spark, d), 10)


def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Four models on one balanced training table, each with its bootstrap report."""
    data = prepared(spark, d, balance=True)
    scorers = {
        "lasso": searched_lasso(data).scorer,
        "network": network.fit_network(data.train, {"size": 3, "decay": 0.1}),
        "svm": models.platt_svm(data.train, "row_id", 0.1),
        "trees": models.boosted_trees(data.train, TREES),
    }
    scored = reduce(DataFrame.unionByName, [
        _risks(fit(data.test)).withColumn("model", F.lit(name)) for name, fit in scorers.items()
    ])
    # bootstrap runs are keyed by number, the model's place in the list
    names = F.array(*[F.lit(n) for n in scorers])
    runs = cut_lineage(scored.withColumn("imp", F.array_position(names, F.col("model")).cast("int")))
    wide = validate.bootstrap_metrics(runs, ["imp"], "row_id", replicates=REPLICATES, seed=7, method="exact")
    long = validate.long_metrics(wide.withColumn("model", names[F.col("imp") - 1]), ["model", "replicate"])
    return validate.metric_summary(long, ["model"])


def imputed_validation(spark: SparkSession, d: str) -> DataFrame:
    """The whole way: impute, then split, balance, search, fit, score and bootstrap every run."""
    gaps = train_missing(spark, d)
    runs = {1: 100, 2: 200}
    filled = cut_lineage(impute.sample_impute(gaps, "row_id", ["fa", "bmi", "education"], runs))
    scored = score_runs(
        filled, list(runs), "y", "row_id", NUMERIC, CATEGORICAL, lambda train, _: models.lasso_cv(train, "row_id").scorer, {})
    return validate.validation_report(scored, ["imp"], "row_id", REPLICATES, seed=7, method="exact")


def replicate_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of the replicates' metrics."""
    wide = validate.bootstrap_metrics(scored(spark, d), ["imp"], "row_id", REPLICATES, 7)
    return profile.histogram(validate.long_metrics(wide.select(*[F.round(m, 9).alias(m) for m in validate.METRICS]), []), "metric", "value")


QUERIES = {
    f.__name__: f
    for f in (
        lasso_cv, lasso_coefficients, score, mlp_train, random_search_cv, linear_svm, platt_scaling,
        grid_search_cv, gbt_train, gbt_search_cv, shap_values, shap_summary, model_comparison, imputed_validation,
        lasso_path_check, grid_search_check, shap_additivity, lasso_coefficient_runs, replicate_histograms,
    )
}
