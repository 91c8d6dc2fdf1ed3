"""Categorical codes, one-hot columns and the feature vector."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LEVELS = 1_000


def fit_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[Any]]:
    """Sorted distinct levels per column. Few by nature; more than MAX_LEVELS is an error."""
    if not columns:
        return {}
    counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    wide = [c for c in columns if counts[c] > MAX_LEVELS]
    if wide:
        raise ValueError(f"not categorical: {', '.join(wide)}")
    row = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns]).first()
    return {c: list(row[c]) for c in columns}


def factor_encode(df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence[Any]] | None = None) -> DataFrame:
    """Add ``<column>_code``: the 1-based place of the level; NULL for NULL and unknown levels."""
    levels = levels or fit_levels(df, columns)
    return df.withColumns({
        f"{c}_code": F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels[c]]), F.col(c)), F.lit(0)).cast("int")
        for c in columns
    })


def one_hot_names(levels: Mapping[str, Sequence[Any]]) -> list[str]:
    return [f"{c}_{v}" for c, vs in levels.items() for v in vs]


def one_hot(df: DataFrame, levels: Mapping[str, Sequence[Any]]) -> DataFrame:
    """A 0/1 column for every level (none dropped) in place of each categorical.

    Levels are fitted once and used for every table; an unknown level is all zeros.
    """
    hot = [
        F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}_{v}")
        for c, vs in levels.items() for v in vs
    ]
    return df.select(*[c for c in df.columns if c not in levels], *hot)


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error").transform(df)
