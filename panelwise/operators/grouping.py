"""Group-derived values and ordering inside groups, safe for very large groups.

One participant, cohort or run may hold a large share of all rows. So values of
a group are aggregated (map-side first) and joined back, where adaptive
execution may split a hot key, and positions inside a group are counted in two
levels: inside order-preserving buckets, plus what the earlier buckets hold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.expr import as_col

MAX_CUTS = 1024
ROWS_PER_BUCKET = 100_000


def attach_group(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Add group aggregates to every row. Rows with a NULL key get NULLs."""
    stats = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    return df.join(stats, list(keys), "left").select(*df.columns, *aggs)


def keep_groups(df: DataFrame, keys: Sequence[str], having: Column) -> DataFrame:
    """Rows of the groups whose aggregate condition holds."""
    good = df.groupBy(*keys).agg(having.alias("_keep")).where("_keep").select(*keys)
    return df.join(good, list(keys), "left_semi")


def _earlier(
    parts: DataFrame, keys: Sequence[str], sums: Sequence[str], minima: Sequence[str] = ()
) -> DataFrame:
    """Per bucket: sums over the earlier buckets of its group (few buckets per group)."""
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(s).over(group).alias(f"_tot_{s}") for s in sums],
        *[F.min(m).over(group).alias(m) for m in minima],
    )


def ordered_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str,
    group_min: Mapping[str, Column] = {},
    group_size: str | None = None,
) -> DataFrame:
    """1-based position of each row in its group under ``order``.

    ``bucket`` must not decrease along ``order``; it bounds what one task sorts.
    ``group_min`` and ``group_size`` add minima and the row count of the whole group
    on the way.
    """
    d = df.withColumn("_bucket", bucket)
    parts = d.groupBy(*keys, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), *[F.min(e).alias(n) for n, e in group_min.items()]
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    size = [F.col("_tot__n").alias(group_size)] if group_size else []
    return (
        d.withColumn("_inside", inside)
        .join(_earlier(parts, keys, ["_n"], list(group_min)), [*keys, "_bucket"])
        .select(
            *df.columns, (F.col("_inside") + F.col("_before__n")).cast("long").alias(name), *group_min, *size
        )
    )


def hash_index(
    df: DataFrame, keys: Sequence[str], row_id: str, name: str, group_size: str | None = None
) -> DataFrame:
    """Dense 1-based row index per group in md5 order of the row id.

    The first hex digits of the hash are evenly filled, order-preserving buckets,
    so no group, however large, is ever sorted by one task.
    """
    d = df.withColumn("_md5", F.md5(F.col(row_id).cast("string")))
    d = ordered_index(d, keys, ["_md5", row_id], F.substring("_md5", 1, 3), name, group_size=group_size)
    return d.drop("_md5")


def value_cuts(df: DataFrame, value: str) -> list[float]:
    """Cut points that spread rows evenly over buckets; at most MAX_CUTS numbers."""
    n = df.count()
    buckets = min(MAX_CUTS, -(-n // ROWS_PER_BUCKET))
    if buckets <= 1:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(as_col(value).cast("double"), shares, 10_000).alias("q")).first()
    return sorted(set(row["q"] or []))


def with_bucket(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """Add ``_bucket``, which does not decrease with the value; found by binary search."""
    if not cuts:
        return df.withColumn("_bucket", F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    d = df.withColumn("_cut", F.col(value).cast("double"))
    d = Bucketizer(splits=splits, inputCol="_cut", outputCol="_slot").transform(d)
    return d.withColumn("_bucket", F.col("_slot").cast("int")).drop("_cut", "_slot")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    *,
    descending: bool = False,
    cuts: Sequence[float] | None = None,
    totals: bool = True,
) -> DataFrame:
    """Add ``cum_<s>`` (up to and with this row) and ``tot_<s>`` for each summed column.

    ``order`` must be unique inside a group: aggregate ties first. Rows whose order value is NULL
    or NaN have no place and are left out, with and without cuts.
    """
    df = df.where(F.col(order).isNotNull() & ~F.isnan(F.col(order).cast("double")))
    if cuts is None:
        cuts = value_cuts(df, order)
    sort = F.col(order).desc() if descending else F.col(order).asc()
    if not cuts:
        w = Window.partitionBy(*keys).orderBy(sort)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*keys)
        out = df.select("*", *[F.sum(s).over(upto).alias(f"cum_{s}") for s in sums])
        return out.select("*", *[F.sum(s).over(whole).alias(f"tot_{s}") for s in sums]) if totals else out
    d = with_bucket(df, order, cuts)
    d = d.withColumn("_bucket", -F.col("_bucket")) if descending else d
    parts = d.groupBy(*keys, "_bucket").agg(*[F.sum(s).alias(s) for s in sums])
    w = Window.partitionBy(*keys).orderBy("_bucket")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = parts.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(s).over(whole).alias(f"tot_{s}") for s in sums],
    )
    upto = (
        Window.partitionBy(*keys, "_bucket").orderBy(sort)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = d.select("*", *[F.sum(s).over(upto).alias(f"_in_{s}") for s in sums])
    out = out.join(offsets, [*keys, "_bucket"])
    return out.select(
        *df.columns,
        *[(F.col(f"_in_{s}") + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums],
        *([F.col(f"tot_{s}") for s in sums] if totals else []),
    )
