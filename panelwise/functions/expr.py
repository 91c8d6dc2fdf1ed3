"""Scalar column expressions.

Every conditional here is NULL-propagating: a NULL test gives NULL, not the
else branch, which is what a statistician expects of a recode.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365
MONTHS_PER_YEAR = 12


def as_col(x: Any) -> Column:
    """A column stays a column, a string names one, anything else is a literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def if_else_null(cond: Column, yes: Any, no: Any) -> Column:
    """``yes`` where cond is true, ``no`` where false, NULL where cond is NULL."""
    yes, no = (x if isinstance(x, Column) else F.lit(x) for x in (yes, no))
    return F.when(cond, yes).when(~cond, no)


def sentinel_to_null(x: Any, codes: Iterable[Any]) -> Column:
    """Codes that mean 'missing' become NULL."""
    c = as_col(x)
    return F.when(~c.isin(list(codes)), c)


def range_to_null(x: Any, low: Any = None, high: Any = None) -> Column:
    """Values below ``low`` or above ``high`` become NULL."""
    c = as_col(x)
    tests = []
    if low is not None:
        tests.append(c >= low)
    if high is not None:
        tests.append(c <= high)
    return F.when(reduce(Column.__and__, tests), c) if tests else c


def cross_invalidate(x: Any, other: Any, high: Any) -> Column:
    """NULL when ``other`` exceeds ``high`` or is itself NULL."""
    return if_else_null(as_col(other) > high, F.lit(None), as_col(x))


def default_fill(x: Any, value: Any, only_if: Column | None = None) -> Column:
    """Default for NULL, optionally only on rows meeting ``only_if``."""
    c = as_col(x)
    test = c.isNull() if only_if is None else c.isNull() & only_if
    return F.when(test, F.lit(value)).otherwise(c)


def years_from_days(days: Any) -> Column:
    return as_col(days) / F.lit(DAYS_PER_YEAR)


def days_from_years(years: Any) -> Column:
    return as_col(years) * F.lit(DAYS_PER_YEAR)


def years_from_months(months: Any) -> Column:
    return as_col(months) / F.lit(MONTHS_PER_YEAR)


def round_even(x: Any, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(as_col(x), digits)


def negative_fix(t: Any, visit_months: Any) -> Column:
    """A negative time is replaced by the time the visit code stands for."""
    c = as_col(t)
    return if_else_null(c < 0, years_from_months(visit_months), c)


def interval_flag_fill(flag: Any, start: Any, end: Any, length: Any, at: Column) -> Column:
    """Fill a NULL flag, on rows meeting ``at``, with 'interval is at least this long'."""
    f = as_col(flag)
    long_enough = if_else_null((as_col(end) - as_col(start)) >= as_col(length), 1, 0)
    return if_else_null(f.isNull() & at, long_enough, f)


def in_interval_flag(flag: Any, start: Any, end: Any, point: Any) -> Column:
    """Keep a known flag, else 'point lies in [start, end]'; NULL when both ends are unknown."""
    f, s, e, p = (as_col(x) for x in (flag, start, end, point))
    inside = if_else_null((s <= p) & (e >= p), 1, 0)
    return F.when(s.isNotNull() | e.isNotNull(), F.coalesce(f, inside))


def threshold_flag(x: Any, cut: float, *, strict: bool = False) -> Column:
    """1 when x reaches the cut (or exceeds it, if strict), 0 below, NULL when unknown."""
    c = as_col(x)
    return if_else_null(c > cut if strict else c >= cut, 1, 0)


def merge_levels(x: Any, mapping: Mapping[Any, Any]) -> Column:
    """Fold category levels together; levels not in the mapping stay."""
    c = as_col(x)
    out = c
    for old, new in mapping.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out


def any_not_null(cols: Iterable[str]) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()
