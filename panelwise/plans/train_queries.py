"""Registered queries: imputation, neighbours, balancing, encoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.operators import encode, impute
from panelwise.operators.balance import smote as smote_rows
from panelwise.operators.neighbours import nearest_neighbours
from panelwise.plans.score_queries import exact_mean
from panelwise.plans.views import train_missing, train_table

NUMERIC = ["fa", "bmi", "age_questionnaire"]
CATEGORICAL = ["education", "stage", "tumortype"]


def recoded(t: DataFrame) -> DataFrame:
    return t.withColumns({c: F.col(c).cast("int") for c in CATEGORICAL})


def sample_impute(spark: SparkSession, d: str) -> DataFrame:
    t = impute.sample_impute(train_missing(spark, d), "row_id", ["fa", "bmi", "education"], {1: 100})
    return t.select("imp", "row_id", F.round("fa", 6).alias("fa"), F.round("bmi", 6).alias("bmi"), "education", "y")


def stack_imputations(spark: SparkSession, d: str) -> DataFrame:
    t = impute.sample_impute(train_missing(spark, d), "row_id", ["fa", "bmi"], {i: 100 * i for i in range(1, 11)})
    return t.groupBy("imp").agg(
        F.count(F.lit(1)).alias("n"), exact_mean(F.col("fa")).alias("mean_fa"), exact_mean(F.col("bmi")).alias("mean_bmi")
    )


def forest_impute(spark: SparkSession, d: str) -> DataFrame:
    t = recoded(train_missing(spark, d))
    return impute.forest_impute(t, "row_id", NUMERIC, [*CATEGORICAL, "y"], seed=100).select("row_id", *NUMERIC, *CATEGORICAL, "y")


def forest_impute_check(spark: SparkSession, d: str) -> DataFrame:
    """Known cells as they were; of the gaps, whether they are filled with something the column allows."""
    gaps = recoded(train_missing(spark, d)).select("row_id", *[F.col(c).alias(f"was_{c}") for c in ("fa", "bmi", "education")])
    ends = gaps.agg(*[f(f"was_{c}").alias(f"{k}_{c}") for c in ("fa", "bmi") for k, f in (("low", F.min), ("high", F.max))]).first()
    d_ = forest_impute(spark, d).join(gaps, "row_id")
    fits = [F.col(c).between(ends[f"low_{c}"], ends[f"high_{c}"]) for c in ("fa", "bmi")] + [F.col("education").isin(1, 2, 3, 5, 98)]
    kept = [F.when(F.col(f"was_{c}").isNotNull(), F.round(c, 6)).alias(c) for c in ("fa", "bmi")]
    kept.append(F.when(F.col("was_education").isNotNull(), F.col("education")).alias("education"))
    return d_.select("row_id", *kept, reduce(lambda a, b: a & b, fits).alias("filled"))


def multiple_impute(spark: SparkSession, d: str) -> DataFrame:
    one = impute.forest_imputer(recoded(train_missing(spark, d)), "row_id", NUMERIC, [*CATEGORICAL, "y"])
    return impute.multiple_impute(one).select("imp", "row_id", *NUMERIC, *CATEGORICAL, "y")


def minority_knn(spark: SparkSession, d: str) -> DataFrame:
    rare = train_table(spark, d).where("y = 1")
    near = nearest_neighbours(rare, "row_id", NUMERIC, CATEGORICAL, 5)
    return near.select("row_id", "rank", "neighbour_id", F.round("distance2", 6).alias("distance2"))


def smote(spark: SparkSession, d: str) -> DataFrame:
    t = smote_rows(train_table(spark, d), "y", "row_id", NUMERIC, CATEGORICAL, over=4, under=3, k=5, seed=1)
    return t.select("row_id", "copy", "kind", "y", *[F.round(c, 6).alias(c) for c in NUMERIC], *CATEGORICAL)


def one_hot(spark: SparkSession, d: str) -> DataFrame:
    t = train_table(spark, d).select("row_id", "education", "stage", "y")
    return encode.one_hot(t, encode.fit_levels(t, ["education", "stage"]))


QUERIES = {
    f.__name__: f
    for f in (
        sample_impute, stack_imputations, minority_knn, smote, one_hot, forest_impute, multiple_impute, forest_impute_check,
    )
}
