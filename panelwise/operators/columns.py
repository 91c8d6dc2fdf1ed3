"""Projection helpers: by-name selection, column moves, conditional updates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names_at(df: DataFrame, *positions: int | tuple[int, int]) -> list[str]:
    """Column names at 1-based positions; a pair is an inclusive range."""
    out = []
    for p in positions:
        low, high = p if isinstance(p, tuple) else (p, p)
        out += df.columns[low - 1 : high]
    return out


def keep_columns(df: DataFrame, *positions: int | tuple[int, int]) -> DataFrame:
    return df.select(*names_at(df, *positions))


def drop_columns(df: DataFrame, *positions: int | tuple[int, int]) -> DataFrame:
    return df.drop(*names_at(df, *positions))


def relocate(df: DataFrame, column: str, *, after: str | None = None, before: str | None = None) -> DataFrame:
    """Move a column next to another, or to the front."""
    rest = [c for c in df.columns if c != column]
    at = rest.index(after) + 1 if after else rest.index(before) if before else 0
    return df.select(*rest[:at], column, *rest[at:])


def recode(df: DataFrame, columns: Sequence[str], f: Callable[[str], Column]) -> DataFrame:
    """Apply one function to each of the columns."""
    return df.withColumns({c: f(c) for c in columns})


def update_where(df: DataFrame, cond: Column, values: Mapping[str, Any]) -> DataFrame:
    """Set columns on the rows meeting the condition; other rows keep their values."""
    new = {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()}
    return df.withColumns({c: F.when(cond, v).otherwise(F.col(c)) for c, v in new.items()})
