"""From imputed tables to a validation report: split, balance, fit and score every run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.operators import encode
from panelwise.operators.balance import smote
from panelwise.operators.sampling import train_test_split
from panelwise.operators.tuning import Fit
from panelwise.session import cut_for_fitting, cut_lineage


@dataclass
class Design:
    """Feature vectors of the training and the test part, and the feature names."""

    train: DataFrame
    test: DataFrame
    features: list[str]


def design(
    table: DataFrame, label: str, row_id: str, numeric: Sequence[str], categorical: Sequence[str],
    *, weights: tuple[float, float] = (0.7, 0.3), seed: int = 100, balance: bool = True, run: str | None = None,
) -> Design:
    """Split, rebalance the training part, one-hot with levels fitted once, assemble."""
    t = table.withColumns({c: F.col(c).cast("double") for c in numeric})
    t = cut_lineage(train_test_split(t, row_id, weights, seed, run))
    levels = encode.fit_levels(t, categorical)
    features = [*numeric, *encode.one_hot_names(levels)]
    train, test = t.where("is_train"), t.where("NOT is_train")
    if balance:
        train = smote(train, label, row_id, numeric, categorical, over=4, under=3, k=5, seed=seed)
        # copies and synthetic rows need ids of their own for the folds
        train = train.withColumn(row_id, F.abs(F.xxhash64("kind", row_id, "copy")))

    def vectors(df: DataFrame) -> DataFrame:
        df = df.select(row_id, F.col(label).cast("double").alias("label"), *numeric, *categorical)
        hot = encode.one_hot(df, levels)
        return cut_for_fitting(encode.assemble(hot, features).select(row_id, "label", "features"))

    return Design(vectors(train), vectors(test), features)


def score_runs(
    imputed: DataFrame, runs: Sequence[int], label: str, row_id: str, numeric: Sequence[str],
    categorical: Sequence[str], fit: Fit, params: Mapping, **options,
) -> DataFrame:
    """One model per imputed table, all test scores stacked: (imp, row, y, p), ready to be validated."""
    parts = []
    for i in runs:
        d = design(imputed.where(F.col("imp") == i), label, row_id, numeric, categorical, **options)
        scored = fit(d.train, params)(d.test)
        parts.append(scored.select(F.lit(i).alias("imp"), row_id, F.col("label").cast("int").alias("y"), "p"))
    return cut_lineage(reduce(DataFrame.unionByName, parts))
