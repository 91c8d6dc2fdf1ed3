"""SHAP values of boosted trees, in time polynomial in the depth.

A feature's value is an integral over t of what the paths through its splits are worth when every other feature of the path is
known with probability t. On a path, a feature that the row meets counts t + (1 - t) z, and one that it misses (1 - t) z, z being the
share of training rows that its splits let through. The product is a polynomial in t whose degree is the number of features, so a
Gauss quadrature of half as many points is exact. Going down a split extends the products at these points by a
factor; coming up, the sums over all leaves below are unwound by dividing it out. A split costs the same whatever hangs
below it, and rows are taken in batches.

Trees reach the tasks as node arrays, read from the model's own stored form.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.session import ensure_checkpoint_dir

#: Rows a task takes through the trees at a time.
ROWS_AT_ONCE = 2_048


@dataclass
class Tree:
    """Nodes in order of id, the root first; -1 for no child. ``share``: of the parent's training rows; ``value`` at leaves on the log-odds scale."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    value: np.ndarray

    def depth(self, node: int = 0) -> int:
        if self.left[node] < 0:
            return 0
        return 1 + max(self.depth(self.left[node]), self.depth(self.right[node]))

    def expected(self, node: int = 0) -> float:
        if self.left[node] < 0:
            return float(self.value[node])
        return sum(float(self.share[c]) * self.expected(c) for c in (self.left[node], self.right[node]))


def trees_of(model, spark: SparkSession) -> list[Tree]:
    """Node arrays of a fitted GBT model; its margin is twice the weighted sum of the trees.

    The model is written to the shared folder and its node table read back: as many rows as it has nodes.
    """
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid4().hex}"
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    pdf = nodes.select("treeID", "id", "prediction", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
                       F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"), F.get("impurityStats", F.lit(0)).alias("rows")).toPandas()
    out = []
    for tree, own in pdf.sort_values(["treeID", "id"]).groupby("treeID", sort=True):
        rows, left, right = own["rows"].to_numpy(float), own["leftChild"].to_numpy(int), own["rightChild"].to_numpy(int)
        share = np.ones(len(own))
        inner = left >= 0
        for side in (left, right):
            share[side[inner]] = rows[side[inner]] / rows[inner]
        value = 2.0 * model.treeWeights[int(tree)] * own["prediction"].to_numpy(float)
        out.append(Tree(own["feature"].to_numpy(int), own["cut"].to_numpy(float), left, right, share, value))
    return out


def base_value(trees: Sequence[Tree]) -> float:
    """The margin that no feature speaks for: shaps of a row add up to its margin less this."""
    return sum(t.expected() for t in trees)


def explain(x: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    """SHAP values of every row (row x feature)."""
    phi = np.zeros_like(x, dtype=float)
    for tree in trees:
        points, weights = np.polynomial.legendre.leggauss(tree.depth() // 2 + 1)
        t, w = (points + 1) / 2, weights / 2
        free = (np.ones(len(x), bool), 1.0, np.ones((1, len(t))))

        def below(node: int, product: np.ndarray, known: dict[int, tuple]) -> np.ndarray:
            """Sum over the leaves below of value times product, at each quadrature point."""
            if tree.left[node] < 0:
                return product * tree.value[node]
            f = int(tree.feature[node])
            met, share, factor = known.get(f, free)
            goes_left = x[:, f] <= tree.cut[node]
            total = 0.0
            for child, goes in ((tree.left[node], goes_left), (tree.right[node], ~goes_left)):
                now, z = met & goes, share * tree.share[child]
                extended = z * (1 - t) + now[:, None] * t
                total_below = below(child, product / factor * extended, {**known, f: (now, z, extended)})
                phi[:, f] += (now - z) * ((total_below / extended) @ w)
                if f in known:  # these leaves' share of what the feature's split further up will count
                    phi[:, f] -= (met - share) * ((total_below / factor) @ w)
                total = total + total_below
            return total

        below(0, np.ones((len(x), len(t))), {})
    return phi


def shap_values(scored: DataFrame, row_id: str, model, features: Sequence[str]) -> DataFrame:
    """(row, feature, value, shap) on the log-odds scale; shaps of a row add up to margin - base. Ids may be of any type."""
    trees = trees_of(model, scored.sparkSession)
    names, n = list(features), len(features)

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in range(0, len(pdf), ROWS_AT_ONCE):
                part = pdf.iloc[first : first + ROWS_AT_ONCE]
                x = np.stack(part["x"].to_numpy())
                yield pd.DataFrame({
                    row_id: np.repeat(part[row_id].to_numpy(), n), "feature": names * len(x),
                    "value": x.ravel(), "shap": explain(x, trees).ravel(),
                })

    data = scored.select(row_id, vector_to_array("features").alias("x"))
    kind = scored.schema[row_id].dataType.simpleString()
    return data.mapInPandas(attribute, f"`{row_id}` {kind}, feature string, value double, shap double")


def shap_summary(shap: DataFrame, top: int = 10) -> DataFrame:
    """The features with the largest mean absolute SHAP."""
    return (
        shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"), F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("mean_abs_shap"), "feature").limit(top)
    )
