"""Table profiles: counts, quantiles, missingness, histograms."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.expr import as_col
from panelwise.session import cut_lineage


def stack_columns(df: DataFrame, columns: Sequence[str], key: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """Columns to (key, value) rows, as doubles."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    return df.select(*keep, F.expr(f"stack({len(columns)}, {pairs}) AS ({key}, {value})"))


def dataset_overview(df: DataFrame, person: str = "participant_id") -> DataFrame:
    """Distinct participants, rows and columns."""
    people = df.groupBy(person).agg(F.count(F.lit(1)).alias("n"))
    return people.agg(
        F.count(person).alias("participants"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
    ).withColumn("columns", F.lit(len(df.columns)))


def apply_columns(df: DataFrame, columns: Sequence[str], f: Callable[[str], Column], value: str = "value") -> DataFrame:
    """One aggregate of each column, in one pass, as (column, value) rows."""
    one = df.agg(*[f(c).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.select(F.expr(f"stack({len(columns)}, {pairs}) AS (column_name, {value})"))


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return apply_columns(df, columns, lambda c: F.count_if(F.col(c).isNull()), "missing")


def level_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per level, NULL among them."""
    return df.groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def outcome_by_group(df: DataFrame, outcome: str, group: str) -> DataFrame:
    """Known outcomes per group and their share of the group."""
    counts = df.where(F.col(outcome).isNotNull()).groupBy(outcome, group).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(group).agg(F.sum("n").alias("_total"))
    return counts.join(total, group).select(
        outcome, group, "n", F.round(F.col("n") / F.col("_total"), 6).alias("share")
    )


QUARTERS = {"q1": 0.25, "median": 0.5, "q3": 0.75}


BUCKETS = 1_024


def exact_ranks(df: DataFrame, ranks: Mapping[str, Sequence[int]]) -> dict[tuple[str, int], float]:
    """The values at given 0-based ranks among the known values of each column, exactly.

    Passes over the table count values in BUCKETS equal buckets of an interval for each rank, with the buckets' least and greatest
    values, and narrow it to the bucket that holds the rank, until only one value is left in it. No pass shuffles more than
    the buckets' counts. NaN counts as unknown.
    """
    found: dict[tuple[str, int], float] = {}
    wanted = {(c, r) for c, rs in ranks.items() for r in rs}
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in ranks}
    ends = df.agg(*[f(value[c]).alias(f"{k}{i}") for i, c in enumerate(ranks) for k, f in (("a", F.min), ("b", F.max))]).first() if ranks else None
    # (column, low, high, values below) -> the ranks that lie there
    spans: dict[tuple[str, float, float, int], set[int]] = {}
    for i, c in enumerate(ranks):
        if ends[f"a{i}"] is not None:
            spans[c, ends[f"a{i}"], ends[f"b{i}"], 0] = set(ranks[c])
    while spans:
        open_ = [s for s in spans if s[1] < s[2]]
        for c, low, _, _ in [s for s in spans if s[1] == s[2]]:
            found.update({(c, r): low for r in spans[c, low, low, _]})
        if not open_:
            break
        cells = []
        for i, (c, low, high, _) in enumerate(open_):
            width = high / BUCKETS - low / BUCKETS
            slot = F.least(F.floor((value[c] - low) / width) if width > 0 else (value[c] > low).cast("long"), F.lit(BUCKETS - 1))
            inside = value[c].between(low, high)
            cells.append(F.when(inside, F.struct(F.lit(i).alias("i"), slot.cast("int").alias("slot"), value[c].alias("v"))))
        rows = df.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x"))
        counts = rows.groupBy("x.i", "x.slot").agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("low"), F.max("x.v").alias("high"))
        old, spans = spans, {}
        by_span: dict[int, list] = {}
        for r in counts.collect():
            by_span.setdefault(r.i, []).append(r)
        for i, rows_ in by_span.items():
            c, _, _, below = open_[i]
            for r in sorted(rows_, key=lambda r: r.slot):
                hits = {k for k in old[open_[i]] if below <= k < below + r.n}
                if hits:
                    spans.setdefault((c, r.low, r.high, below), set()).update(hits)
                below += r.n
    return {k: found[k] for k in wanted if k in found}


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of the known values of each column, interpolated between neighbouring ranks; None without values."""
    if not columns:
        return {}
    n = df.agg(*[F.count(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in columns]).first()
    places = {c: [(n[c] - 1) * share for share in shares] for c in columns if n[c]}
    values = exact_ranks(df, {c: sorted({f(p) for p in ps for f in (math.floor, math.ceil)}) for c, ps in places.items()})

    def at(c: str, place: float) -> float:
        low, high = values[c, math.floor(place)], values[c, math.ceil(place)]
        return low + (high - low) * (place - math.floor(place))

    return {c: [at(c, p) for p in places[c]] if c in places else [None] * len(shares) for c in columns}


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min, quartiles (interpolated), mean, max and NULL count per column.

    Exact at any size: one aggregate for all but the quartiles, which come from passes that narrow down to their ranks.
    """
    df = cut_lineage(df.select(*columns))
    v = {c: F.col(c).cast("double") for c in columns}
    basics = df.agg(*[e.alias(f"{k}{i}") for i, c in enumerate(columns) for k, e in (
        ("min", F.min(v[c])), ("mean", F.avg(v[c])), ("max", F.max(v[c])), ("nulls", F.count_if(v[c].isNull())))]).first()
    quartiles = exact_quantiles(df, columns, list(QUARTERS.values()))
    rows = [(c, basics[f"min{i}"], *quartiles[c], basics[f"mean{i}"], basics[f"max{i}"], basics[f"nulls{i}"]) for i, c in enumerate(columns)]
    names = ["min", *QUARTERS, "mean", "max"]
    out = df.sparkSession.createDataFrame(rows, "column_name string, min double, q1 double, median double, q3 double, mean double, max double, nulls long")
    return out.select("column_name", *[F.round(n, 6).alias(n) for n in names], "nulls")


def histogram(df: DataFrame, group: str, value: str) -> DataFrame:
    """Equal-width bins per group, their number by Sturges' rule, NULLs left out."""
    d = df.where(as_col(value).isNotNull())
    span = d.groupBy(group).agg(
        F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(F.lit(1)).alias("_n")
    )
    span = span.withColumn("_k", (F.ceil(F.log2(F.col("_n"))) + 1).cast("int"))
    span = span.withColumn("_w", (F.col("_high") - F.col("_low")) / F.col("_k"))
    pos = F.when(F.col("_w") > 0, F.floor((F.col(value) - F.col("_low")) / F.col("_w"))).otherwise(F.lit(0))
    bins = d.join(span, group).withColumn("bin", F.least(pos.cast("int"), F.col("_k") - 1))
    return bins.groupBy(group, "bin").agg(
        F.round(F.max(F.col("_low") + F.col("bin") * F.col("_w")), 6).alias("bin_start"),
        F.count(F.lit(1)).alias("n"),
    )


def summarise(df: DataFrame, group: str, value: str, digits: int = 6) -> DataFrame:
    """Mean and sample sd per group, NULLs ignored."""
    return df.groupBy(group).agg(
        F.round(F.avg(value), digits).alias("mean"),
        F.round(F.stddev_samp(value), digits).alias("sd"),
        F.count(value).alias("n"),
    )
