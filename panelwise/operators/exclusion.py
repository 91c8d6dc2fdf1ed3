"""Row exclusions, key repair and the attrition report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.expr import any_not_null

MAX_MAPPING = 1_000


def any_answer(df: DataFrame, items: Sequence[str], by_source: Mapping[str, Sequence[str]] = {}) -> DataFrame:
    """Rows with at least one answer; some cohorts are judged on other items. One pass."""
    ok = any_not_null(items)
    for source, cols in by_source.items():
        ok = F.when(F.col("source") == source, any_not_null(cols)).otherwise(ok)
    return df.where(ok)


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def exclude_category(df: DataFrame, column: str, level: Any) -> DataFrame:
    """Rows known not to be of the level; NULLs go too."""
    return df.where(F.col(column) != level)


def remap_keys(
    df: DataFrame, column: str, mapping: Mapping[Any, Any], *, where: Column | None = None, null_to: Any = None
) -> DataFrame:
    """Replace listed ids, and optionally a NULL id, on the rows meeting ``where``.

    The mapping is a hand-written list, looked up as a literal; one too long for that
    is refused (put it in a table and join).
    """
    if len(mapping) > MAX_MAPPING:
        raise ValueError(f"more than {MAX_MAPPING} pairs: join a mapping table")
    type_ = df.schema[column].dataType
    id_ = F.col(column)
    new = id_
    if mapping:
        pairs = F.create_map(*[F.lit(x).cast(type_) for pair in mapping.items() for x in pair])
        new = F.coalesce(F.try_element_at(pairs, id_), id_)
    if null_to is not None:
        new = F.coalesce(new, F.lit(null_to).cast(type_))
    return df.withColumn(column, new if where is None else F.when(where, new).otherwise(id_))


def attrition_report(
    df: DataFrame, steps: Mapping[str, Column], *, person: str = "participant_id", cohort: str = "source"
) -> DataFrame:
    """Participants left after every exclusion, per cohort and in all, with % of the start.

    Steps accumulate. Participants are reduced first (one row each), then counted, so
    there is one pass and no distinct per step.
    """
    names = ["start", *steps]
    conds = [F.coalesce(c, F.lit(False)) for c in steps.values()]
    alive = [F.lit(True)] + [reduce(Column.__and__, conds[: i + 1]) for i in range(len(conds))]
    people = df.groupBy(cohort, person).agg(
        *[F.max(a.cast("int")).alias(f"_s{i}") for i, a in enumerate(alive)]
    )
    counts = people.rollup(cohort).agg(
        F.grouping(cohort).alias("_all"), *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(names))]
    )
    pairs = ", ".join(f"{i}, '{n}', _s{i}" for i, n in enumerate(names))
    long = counts.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col(cohort)).alias(cohort), "_s0",
        F.expr(f"stack({len(names)}, {pairs}) AS (step_no, step, participants)"),
    )
    return long.select(
        cohort, "step_no", "step", "participants",
        F.round(F.col("participants") * 100.0 / F.col("_s0"), 4).alias("pct_of_start"),
    )
