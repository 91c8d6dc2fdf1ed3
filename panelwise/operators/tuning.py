"""Hyper-parameter candidates and cross-validation on hashed folds."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.functions.hashing import hash_uniform

Scorer = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame, Mapping[str, Any]], Scorer]

# The ranges random search draws from, and the cost and penalty grids.
RANDOM_TREES = {
    "nrounds": ("int", 1, 1000), "max_depth": ("int", 1, 10), "eta": ("real", 0.001, 0.6),
    "gamma": ("real", 0, 10), "subsample": ("real", 0.25, 1), "min_child_weight": ("int", 0, 20),
}
RANDOM_NETWORK = {"size": ("int", 1, 20), "decay": ("power", -5, 1)}
COSTS = [10 ** (-1 - 6 * i / 9) for i in range(10)]
PENALTIES = [10 ** (10 - 12 * i / 99) for i in range(100)]


def random_candidates(ranges: Mapping[str, tuple], n: int = 10, seed: int = 1) -> list[dict[str, Any]]:
    rng = random.Random(seed)
    draw = {
        "int": lambda a, b: rng.randint(a, b),
        "real": lambda a, b: rng.uniform(a, b),
        "power": lambda a, b: 10 ** rng.uniform(a, b),
    }
    return [{k: draw[kind](a, b) for k, (kind, a, b) in ranges.items()} for _ in range(n)]


def with_folds(df: DataFrame, row_id: str, folds: int = 10, seed: int = 1) -> DataFrame:
    return df.withColumn("fold", F.floor(hash_uniform(seed, row_id, F.lit("fold")) * folds).cast("int"))


def accuracy(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hit = ((F.col("p") >= 0.5).cast("double") == F.col("label")).cast("double")
    return scored.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def cross_validate(
    folded: DataFrame, candidates: Sequence[Mapping[str, Any]], fit: Fit, folds: int = 10, parallel: int = 8
) -> list[dict[str, Any]]:
    """Accuracy of every candidate on every fold. Fits are Spark jobs; several run at a time."""

    def one(task: tuple[int, int]) -> dict[str, Any]:
        i, fold = task
        scorer = fit(folded.where(F.col("fold") != fold), candidates[i])
        row = accuracy(scorer(folded.where(F.col("fold") == fold))).first()
        return {"candidate": i, "fold": fold, "accuracy": row["accuracy"], "n": row["n"]}

    tasks = [(i, f) for i in range(len(candidates)) for f in range(folds)]
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(one, tasks))


def mean_accuracy(results: Sequence[Mapping[str, Any]]) -> dict[int, float]:
    """Per candidate, folds weighted by their rows; an empty fold has no say."""
    total: dict[int, list[float]] = {}
    for r in results:
        if r["n"]:
            t = total.setdefault(r["candidate"], [0.0, 0.0])
            t[0] += r["accuracy"] * r["n"]
            t[1] += r["n"]
    return {i: hits / n for i, (hits, n) in total.items()}


def best_candidate(results: Sequence[Mapping[str, Any]]) -> int:
    """Highest mean accuracy, the first listed on ties."""
    means = mean_accuracy(results)
    return min(means, key=lambda i: (-means[i], i))


def results_table(df: DataFrame, results: Sequence[Mapping[str, Any]], candidates: Sequence[Mapping[str, Any]]) -> DataFrame:
    """The search as a table: a row per candidate and fold, hyper-parameters alongside."""
    names = list(candidates[0])
    rows = [
        (r["candidate"], *[float(candidates[r["candidate"]][n]) for n in names], r["fold"], r["accuracy"])
        for r in results
    ]
    schema = "candidate int, " + "".join(f"`{n}` double, " for n in names) + "fold int, accuracy double"
    return df.sparkSession.createDataFrame(rows, schema)
