"""Operators along a participant's visits: carry, follow-up windows, baseline and endpoint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.expr import round_even
from panelwise.operators.grouping import attach_group, keep_groups, value_cuts, with_bucket

KEY = ("source", "participant_id")


@dataclass(frozen=True)
class Carry:
    """Fill a NULL in ``column`` from the same participant's visit ``donor``, plus ``offset``."""

    column: str
    donor: int
    offset: float = 0
    only_if: Column | None = None


def donor_values(df: DataFrame, wants: Mapping[str, tuple[str, int]], keys: Sequence[str] = KEY) -> DataFrame:
    """Add columns holding a participant's value of a column at a given visit.

    ``wants`` maps the new name to (column, wave). One aggregate serves all of them;
    a missing visit gives NULL. (source, participant_id, wave) is the panel's key.
    """
    return attach_group(
        df, keys, {n: F.max(F.when(F.col("wave") == w, F.col(c))) for n, (c, w) in wants.items()}
    )


def carry(df: DataFrame, rules: Sequence[Carry], keys: Sequence[str] = KEY) -> DataFrame:
    """Apply carries that all read the table as it is now; one shuffle for all of them."""
    wants = {f"_donor_{r.column}_{r.donor}": (r.column, r.donor) for r in rules}
    out = donor_values(df, wants, keys)
    for r in rules:
        c = F.col(r.column)
        test = c.isNull() if r.only_if is None else c.isNull() & r.only_if
        value = F.col(f"_donor_{r.column}_{r.donor}")
        out = out.withColumn(r.column, F.when(test, value + r.offset if r.offset else value).otherwise(c))
    return out.drop(*wants)


def carry_from_visit(df: DataFrame, columns: Sequence[str], donor: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Fill NULLs at the other visits from the donor visit."""
    return carry(df, [Carry(c, donor, only_if=F.col("wave") != donor) for c in columns], keys)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Any]) -> DataFrame:
    """First row per key. Spark keeps one candidate per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def followup_window(df: DataFrame, low: float, high: float, keys: Sequence[str] = KEY) -> DataFrame:
    """Participants whose visits span low..high years (times rounded to one digit)."""
    t = round_even("time_diagnosis", 1)
    return keep_groups(df, keys, (F.max(t) - F.min(t)).between(low, high))


def baseline_window(df: DataFrame, low: float, high: float, keys: Sequence[str] = KEY) -> DataFrame:
    """Participants whose first visit lies within low..high years of the diagnosis."""
    return keep_groups(df, keys, F.min(round_even("time_diagnosis", 2)).between(low, high))


def study_window(
    df: DataFrame, elapsed: tuple[float, float], first_visit: tuple[float, float], keys: Sequence[str] = KEY
) -> DataFrame:
    """Both windows at once, from one aggregate per participant."""
    t1, t2 = round_even("time_diagnosis", 1), round_even("time_diagnosis", 2)
    ok = (F.max(t1) - F.min(t1)).between(*elapsed) & F.min(t2).between(*first_visit)
    return keep_groups(df, keys, ok)


def group_span(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Put a participant's first and last time and the span between on every row."""
    t1, t2 = round_even("time_diagnosis", 1), round_even("time_diagnosis", 2)
    return attach_group(df, keys, {
        "time_elapsed": F.max(t1) - F.min(t1),
        "time_min": F.min(t2),
        "time_max": F.max(t2),
    })


def _candidates(df: DataFrame, fixed: Mapping[str, int]) -> Column:
    """Rows that can be chosen: the fixed visit in some cohorts, any timed visit elsewhere."""
    ok = F.col("time_diagnosis").isNotNull()
    for source, wave in fixed.items():
        ok = F.when(F.col("source") == source, F.col("wave") == wave).otherwise(ok)
    return ok


def _time_order(fixed: Mapping[str, int]) -> Column:
    t = round_even("time_diagnosis", 2)
    return F.when(F.col("source").isin(list(fixed)), F.lit(0.0)).otherwise(t) if fixed else t


def baseline_row(df: DataFrame, fixed: Mapping[str, int] = {}, keys: Sequence[str] = KEY) -> DataFrame:
    """The visit at the earliest (rounded) time, first by wave; a fixed visit in some cohorts."""
    return first_per_key(df.where(_candidates(df, fixed)), keys, [_time_order(fixed), "wave"])


def endpoint_row(df: DataFrame, fixed: Mapping[str, int] = {}, keys: Sequence[str] = KEY) -> DataFrame:
    """The visit at the latest (rounded) time, first by wave; a fixed visit in some cohorts."""
    return first_per_key(df.where(_candidates(df, fixed)), keys, [_time_order(fixed).desc(), "wave"])


def baseline_endpoint(
    df: DataFrame,
    outcome: str,
    predictors: Sequence[str],
    *,
    baseline_fixed: Mapping[str, int] = {},
    endpoint_fixed: Mapping[str, int] = {},
    keys: Sequence[str] = KEY,
) -> DataFrame:
    """One row per participant: baseline predictors, and the outcome at both ends by key.

    The same visits as ``baseline_row`` and ``endpoint_row`` choose, from one aggregate: the table is read
    once and joined with nothing. Rows with a NULL key, and participants without either visit, are left out.
    """
    wave = F.col("wave").cast("long")
    first = F.when(_candidates(df, baseline_fixed), F.struct(_time_order(baseline_fixed), wave))
    last = F.when(_candidates(df, endpoint_fixed), F.struct(_time_order(endpoint_fixed), F.coalesce(-wave, F.lit(1 << 62))))
    base = F.struct(*predictors, F.col(outcome).alias(f"{outcome}_base"))
    end = F.struct(F.col(outcome).alias(f"{outcome}_end"))
    both = df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.min_by(base, first).alias("_first"), F.max_by(end, last).alias("_last")
    )
    return both.where("_first IS NOT NULL AND _last IS NOT NULL").select(*keys, "_first.*", "_last.*")


def trajectories(df: DataFrame, state: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Known states in time order, with position and previous state, one row per visit.

    Rows stay rows (no per-participant list). A participant with very many visits is
    cut into time buckets; the state before a bucket comes from the bucket before.
    """
    d = df.where(F.col(state).isNotNull() & F.col("time_diagnosis").isNotNull())
    d = with_bucket(d, "time_diagnosis", value_cuts(d, "time_diagnosis"))
    order = ["time_diagnosis", "wave"]
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    parts = d.groupBy(*keys, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(state, F.struct(*order)).alias("_last")
    )
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    earlier = parts.select(
        *keys, "_bucket",
        F.coalesce(
            F.sum("_n").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_skip"),
        F.lag("_last").over(by_bucket).alias("_state_before"),
    )
    inside = d.withColumns({
        "_pos": F.row_number().over(w),
        "_prev": F.lag(state).over(w),
    })
    return inside.join(earlier, [*keys, "_bucket"]).select(
        *keys, "wave", "time_diagnosis", state,
        (F.col("_pos") + F.col("_skip")).cast("long").alias("seq"),
        F.when(F.col("_pos") == 1, F.col("_state_before")).otherwise(F.col("_prev")).alias("previous"),
    )
