"""Exact k nearest neighbours inside one table.

Distance: squared differences of range-scaled numerics plus 1 per differing category;
ties go to the smaller id. Rows are grouped around pivot rows, about as many as the square root of the table's size, and
the pivots around pivots of their own, so that placing a row costs the fourth root. Each row first searches
its own cell, which bounds how far its k-th neighbour can be, and then only the cells
the triangle inequality cannot rule out: groups of cells first, then the cells of the groups that are left.
Cells are cut into blocks of bounded size, so a crowded cell is many tasks, and a block hands on k candidates per row, never pairs.
The best of a row's candidates are picked before they are shuffled.

Copies of one row are searched once: of equal rows, only the k + 1 smallest ids can be
among anyone's k nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from panelwise.functions.hashing import hash_uniform
from panelwise.session import cut_lineage

#: Pivots at most: they are held by the driver and sent to all tasks.
MAX_PIVOTS = 16_384
BLOCK = 2_000
ROWS_AT_ONCE = 2_048
SLACK = 1e-9
_LISTS = "vid long, d array<double>, id array<long>"


def _squared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All squared distances, added feature by feature in column order."""
    out = np.zeros((len(a[0]), len(b[0])))
    for j in range(a[0].shape[1]):
        diff = a[0][:, j, None] - b[0][None, :, j]
        out += diff * diff
    for j in range(a[1].shape[1]):
        out += a[1][:, j, None] != b[1][None, :, j]
    return out


def _points(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n = len(pdf)
    num = np.array(pdf["num"].tolist(), dtype=float).reshape(n, -1)
    cat = np.array(pdf["cat"].tolist(), dtype=float).reshape(n, -1)
    return num, cat


def _nearest(k: int):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["vid", "d", "id"], dtype=object)
        rows = right.loc[right.index.repeat(right["ids"].str.len())].copy()
        rows["one"] = np.concatenate(right["ids"].to_numpy())
        rows = rows.sort_values("one")
        ids = rows["one"].to_numpy()
        dist = _squared(_points(left), _points(rows))
        best = np.argsort(dist, axis=1, kind="stable")[:, : k + 1]
        return pd.DataFrame({
            "vid": left["vid"].to_numpy(),
            "d": list(np.take_along_axis(dist, best, 1)),
            "id": list(ids[best]),
        })

    return search


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """The k + 1 best of the candidate lists of each row, as an ordered array of (d, id)."""
    each = lists.select("vid", F.explode(F.arrays_zip("d", "id")).alias("x")).select("vid", "x.d", "x.id")
    place = Window.partitionBy("vid").orderBy("d", "id")
    best = each.withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") <= k + 1)
    return best.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("best"))


def _block_search(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Match queries (vid, num, cat, cell) with candidates of the same cell, block by block."""
    blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int")
    n_q = queries.groupBy("cell").agg(blocks.alias("n_q"))
    sizes = n_q.join(candidates.groupBy("cell").agg(blocks.alias("n_c")), "cell")

    def part(df: DataFrame, own: str, other: str) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(f"{other}_block")
        out = df.join(sizes, "cell").withColumn(f"{own}_block", F.pmod(F.hash("vid"), F.col(f"n_{own}"))).select("*", copies)
        # both sides may come from one table: columns of their own for each
        return out.select(*[F.col(c).alias(c) for c in out.columns if c not in ("n_q", "n_c")])

    keys = ["cell", "q_block", "c_block"]
    q = part(queries.select("vid", "num", "cat", "cell"), "q", "c").groupBy(*keys)
    c = part(candidates.select("vid", "num", "cat", "cell", "ids"), "c", "q").groupBy(*keys)
    return q.cogroup(c).applyInPandas(_nearest(k), _LISTS)


def _take(points: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points[0][at], points[1][at]


class _Pivots:
    """Pivots in groups around every so many-th of them."""

    def __init__(self, points: tuple[np.ndarray, np.ndarray]):
        n = len(points[0])
        self.points = points
        self.tops = _take(points, np.arange(min(n, math.isqrt(n) + 1)))
        self.group = np.sqrt(_squared(points, self.tops)).argmin(axis=1) if n else np.empty(0, int)
        self.members = [np.flatnonzero(self.group == g) for g in range(len(self.tops[0]))]

    def place(self, rows: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance to its pivot, distance to its group's top) of each row: the nearest pivot of the nearest group."""
        to_top = np.sqrt(_squared(rows, self.tops))
        group = to_top.argmin(axis=1)
        cell, far = np.zeros(len(group), np.int64), np.zeros(len(group))
        for g in np.unique(group):
            own, here = self.members[g], np.flatnonzero(group == g)
            d = np.sqrt(_squared(_take(rows, here), _take(self.points, own)))
            best = d.argmin(axis=1)
            cell[here], far[here] = own[best], d[np.arange(len(here)), best]
        return cell, far, to_top[np.arange(len(group)), group]

    def near(self, rows: tuple[np.ndarray, np.ndarray], bound: np.ndarray, reach: np.ndarray, top_reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that may hold something within the bound: no nearer than the pivot's distance less the cell's reach."""
        limit = bound * (1 + SLACK) + SLACK
        maybe = np.sqrt(_squared(rows, self.tops)) - top_reach <= limit[:, None]
        at, cells = [], []
        for g, own in enumerate(self.members):
            here = np.flatnonzero(maybe[:, g])
            if len(here) and len(own):
                d = np.sqrt(_squared(_take(rows, here), _take(self.points, own)))
                i, j = np.nonzero((d - reach[own] <= limit[here, None]) & np.isfinite(reach[own]))
                at.append(here[i])
                cells.append(own[j])
        return (np.concatenate(at), np.concatenate(cells)) if at else (np.empty(0, int), np.empty(0, int))


def _category(df: DataFrame, name: str) -> Column:
    """A number for each category; of text the first 52 bits of its md5, which a double holds exactly."""
    if isinstance(df.schema[name].dataType, StringType):
        return F.conv(F.substring(F.md5(F.col(name)), 1, 13), 16, 10).cast("double")
    return F.col(name).cast("double")


def nearest_neighbours(
    df: DataFrame, row_id: str, numeric: Sequence[str], categorical: Sequence[str], k: int = 5
) -> DataFrame:
    """(row, rank, neighbour, distance squared) for the k nearest other rows of every row.

    Categories may be text or numbers. A NULL feature has no distance and is refused.
    """
    df = cut_lineage(df.select(row_id, *numeric, *categorical))
    gaps = F.sum(F.expr(" + ".join(f"int(`{c}` IS NULL)" for c in [*numeric, *categorical])))
    spans = df.agg(gaps.alias("_gaps"), *[(F.max(c) - F.min(c)).cast("double").alias(c) for c in numeric]).first()
    if spans["_gaps"]:
        raise ValueError(f"{spans['_gaps']} features are NULL: impute or drop them first")
    num = [F.col(c).cast("double") / F.lit(spans[c]) if spans[c] else F.lit(0.0) for c in numeric]
    cat = [_category(df, c) for c in categorical]
    rows = df.select(
        F.col(row_id).alias("row"),
        F.array(*num).cast("array<double>").alias("num"), F.array(*cat).cast("array<double>").alias("cat"),
    )
    place = Window.partitionBy("num", "cat").orderBy("row")
    few = rows.withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") <= k + 1)
    points = few.groupBy("num", "cat").agg(F.sort_array(F.collect_list("row")).alias("ids"))
    points = cut_lineage(points.withColumn("vid", F.col("ids")[0]))

    # pivots: as many as the root of the number of points, picked by hash
    n_pivots = min(MAX_PIVOTS, max(1, math.isqrt(points.count())))
    pivots = _Pivots(_points(points.orderBy(hash_uniform(17, "vid"), "vid").limit(n_pivots).toPandas()))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in range(0, len(pdf), ROWS_AT_ONCE):
                part = pdf.iloc[first : first + ROWS_AT_ONCE]
                cell, radius, top_radius = pivots.place(_points(part))
                yield part.assign(cell=cell.astype("int32"), radius=radius, top_radius=top_radius)

    schema = "num array<double>, cat array<double>, ids array<long>, vid long, cell int, radius double, top_radius double"
    placed = cut_lineage(points.mapInPandas(assign, schema))
    reach, top_reach = np.full(n_pivots, -np.inf), np.full(len(pivots.members), -np.inf)
    for r in placed.groupBy("cell").agg(F.max("radius").alias("r"), F.max("top_radius").alias("t")).collect():
        reach[r["cell"]] = r["r"]
        g = pivots.group[r["cell"]]
        top_reach[g] = max(top_reach[g], r["t"])

    own = cut_lineage(_merge(_block_search(placed, placed, k), k))

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in range(0, len(pdf), ROWS_AT_ONCE):
                part = pdf.iloc[first : first + ROWS_AT_ONCE]
                at, cell = pivots.near(_points(part), np.sqrt(part["bound"].to_numpy(dtype=float)), reach, top_reach)
                other = cell != part["cell"].to_numpy()[at]
                at, cell = at[other], cell[other]
                yield pd.DataFrame({
                    "vid": part["vid"].to_numpy()[at], "num": part["num"].to_numpy()[at],
                    "cat": part["cat"].to_numpy()[at], "cell": cell.astype("int32"),
                })

    full = F.when(F.size("best") > k, F.element_at("best", k + 1)["d"]).otherwise(F.lit(float("inf")))
    bounded = placed.join(own.select("vid", full.alias("bound")), "vid").select("vid", "num", "cat", "cell", "bound")
    elsewhere = cut_lineage(
        bounded.mapInPandas(probes, "vid long, num array<double>, cat array<double>, cell int")
    )
    lists = own.select("vid", F.col("best.d").alias("d"), F.col("best.id").alias("id"))
    best = _merge(lists.unionByName(_block_search(elsewhere, placed, k)), k)

    found = rows.join(placed.select("num", "cat", "vid"), ["num", "cat"]).select("row", "vid").join(best, "vid")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("row")), 1, k)
    out = found.select("row", F.posexplode(others).alias("pos", "nb"))
    return out.select(
        F.col("row").alias(row_id), (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("nb.id").alias("neighbour_id"), F.col("nb.d").alias("distance2"),
    )
