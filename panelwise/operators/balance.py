"""SMOTE: synthetic rows for the rare class, resampled rows of the common one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.functions.hashing import hash_uniform
from panelwise.operators.grouping import hash_index
from panelwise.operators.neighbours import nearest_neighbours
from panelwise.session import cut_lineage


def smote(
    df: DataFrame, label: str, row_id: str, numeric: Sequence[str], categorical: Sequence[str],
    *, over: int = 4, under: int = 3, k: int = 5, seed: int = 1, minority: int = 1,
) -> DataFrame:
    """Minority rows, ``over`` synthetic rows for each, and ``over * under`` times as many
    common rows, drawn with replacement. ``kind`` and ``copy`` tell them apart.

    A synthetic row lies between a row and one of its k nearest: numerics at a hashed
    fraction of the way, categories from either end.
    """
    keep = [row_id, label, *numeric, *categorical]
    df = cut_lineage(df.select(*keep).withColumns({c: F.col(c).cast("double") for c in numeric}))
    rare, common = df.where(F.col(label) == minority), df.where(F.col(label) != minority)
    near = nearest_neighbours(rare, row_id, numeric, categorical, k)
    have = near.groupBy(row_id).agg(F.max("rank").alias("_have"))
    plan = have.select(row_id, "_have", F.explode(F.sequence(F.lit(1), F.lit(over))).alias("copy"))
    pick = F.floor(hash_uniform(seed, row_id, "copy", F.lit("n")) * F.col("_have")) + 1
    plan = plan.withColumn("rank", pick.cast("int"))
    made = plan.join(near.select(row_id, "rank", "neighbour_id"), [row_id, "rank"]).join(rare, row_id)
    other = rare.select(
        F.col(row_id).alias("neighbour_id"), *[F.col(c).alias(f"_other_{c}") for c in (*numeric, *categorical)]
    )
    gap = hash_uniform(seed, row_id, "copy", F.lit("g"))
    made = made.join(other, "neighbour_id").withColumn("_gap", gap)
    synthetic = made.select(
        row_id, F.col("copy").cast("int").alias("copy"), F.lit("synthetic").alias("kind"), label,
        *[(F.col(c) + F.col("_gap") * (F.col(f"_other_{c}") - F.col(c))).alias(c) for c in numeric],
        *[
            F.when(hash_uniform(seed, row_id, "copy", F.lit(c)) < 0.5, F.col(c)).otherwise(F.col(f"_other_{c}")).alias(c)
            for c in categorical
        ],
    )
    pool = cut_lineage(hash_index(common, [], row_id, "_idx"))
    size = pool.count()
    draws = rare.select(
        F.col(row_id).alias("_by"), F.explode(F.sequence(F.lit(1), F.lit(over * under))).alias("copy")
    )
    at = (F.floor(hash_uniform(seed, "_by", "copy", F.lit("m")) * size) + 1).cast("long")
    drawn = draws.select(F.col("copy").cast("int").alias("copy"), at.alias("_idx")).join(pool, "_idx")

    def as_is(d: DataFrame, kind: str, copy) -> DataFrame:
        return d.select(row_id, copy.alias("copy"), F.lit(kind).alias("kind"), label, *numeric, *categorical)

    return (
        as_is(rare, "original", F.lit(0))
        .unionByName(synthetic)
        .unionByName(as_is(drawn, "common", F.col("copy")))
    )
