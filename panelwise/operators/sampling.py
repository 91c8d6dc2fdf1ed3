"""Seeded splits and bootstrap resamples, independent of partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.hashing import hash_uniform, poisson_one, with_mix_uniform
from panelwise.operators.grouping import hash_index
from panelwise.session import cut_lineage


def train_test_split(
    df: DataFrame, row_id: str, weights: tuple[float, float] = (0.7, 0.3), seed: int = 100, run: str | None = None
) -> DataFrame:
    """Add ``is_train``. With ``run``, every run gets its own mask; without, all share one."""
    share = weights[0] / sum(weights)
    keys = [row_id] if run is None else [run, row_id]
    return df.withColumn("is_train", hash_uniform(seed, *keys) < F.lit(share))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a narrow table over all cores before each row is multiplied a thousandfold."""
    spark = df.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(width, *keys)


def indexed_rows(df: DataFrame, by: Sequence[str], row_id: str) -> DataFrame:
    """Add a dense index 1..n per run, and n. Draws point at these indexes, so the table
    is read on both sides of a join; it is written once.
    """
    return cut_lineage(hash_index(df, by, row_id, "idx", "n_rows"))


def exact_draws(indexed: DataFrame, by: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """n draws with replacement per run and replicate: (by, replicate, idx of the drawn row)."""
    slots = spread(indexed.select(*by, "idx", "n_rows"), "idx")
    slots = slots.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = with_mix_uniform(slots, "u", seed, *by, "replicate", "idx")
    pick = (F.floor(F.col("u") * F.col("n_rows")) + 1).cast("long")
    return drawn.select(*by, "replicate", pick.alias("idx"))


def poisson_weights(df: DataFrame, by: Sequence[str], row_id: str, replicates: int, seed: int) -> DataFrame:
    """Poisson(1) weight of every row in every replicate; rows of weight 0 are left out.

    The resample size varies a little around n. No index, no join and no shuffle of
    draws, so this is the form for tables where n * replicates draws are too many.
    """
    d = spread(df, row_id)
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    d = with_mix_uniform(d, "_u", seed, *by, "replicate", row_id)
    return d.withColumn("weight", poisson_one(F.col("_u")).cast("long")).where("weight > 0").drop("_u")


def check_method(method: str) -> None:
    if method not in ("exact", "poisson"):
        raise ValueError(f"method is exact or poisson, not {method}")


def bootstrap_weights(
    df: DataFrame, by: Sequence[str], row_id: str, replicates: int = 1000, seed: int = 1, method: str = "exact"
) -> DataFrame:
    """(by, replicate, row, weight): how often each row is drawn in each replicate."""
    check_method(method)
    if method == "poisson":
        return poisson_weights(df.select(*by, row_id), by, row_id, replicates, seed).select(
            *by, "replicate", row_id, "weight"
        )
    rows = indexed_rows(df.select(*by, row_id), by, row_id)
    weights = exact_draws(rows, by, replicates, seed).groupBy(*by, "replicate", "idx").agg(
        F.count(F.lit(1)).alias("weight")
    )
    return weights.join(rows.select(*by, "idx", row_id), [*by, "idx"]).select(*by, "replicate", row_id, "weight")


def bootstrap_rows(
    df: DataFrame, by: Sequence[str], row_id: str, payload: Sequence[str],
    replicates: int = 1000, seed: int = 1, method: str = "exact",
) -> DataFrame:
    """(by, replicate, payload, weight) ready to be aggregated; equal draws are not merged."""
    check_method(method)
    if method == "poisson":
        d = poisson_weights(df.select(*by, row_id, *payload), by, row_id, replicates, seed)
        return d.select(*by, "replicate", *payload, "weight")
    rows = indexed_rows(df.select(*by, row_id, *payload), by, row_id)
    draws = exact_draws(rows, by, replicates, seed)
    return draws.join(rows.select(*by, "idx", *payload), [*by, "idx"]).select(
        *by, "replicate", *payload, F.lit(1).cast("long").alias("weight")
    )


def bootstrap_statistics(
    df: DataFrame, by: Sequence[str], row_id: str, payload: Sequence[str], aggs: Mapping[str, Column],
    replicates: int = 1000, seed: int = 1, method: str = "exact",
) -> DataFrame:
    """Any statistic written as an aggregate over ``payload`` and ``weight``, per replicate."""
    drawn = bootstrap_rows(df, by, row_id, payload, replicates, seed, method)
    return drawn.groupBy(*by, "replicate").agg(*[e.alias(n) for n, e in aggs.items()])
