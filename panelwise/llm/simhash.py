"""Near-duplicates by SimHash: fingerprints, links at a few differing bits, connected classes.

Candidate search works on the *segment-popcount embedding*. A fingerprint is cut into 32
segments of two bits; the number of set bits of each segment is a coordinate in {0, 1, 2}. The
Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints.
Coordinates are held in unary (0, 1 and 2 set bits), so the Manhattan distance is the bit count of
an exclusive or.

The grid: coordinates are dealt into ``bands`` groups. Points at Manhattan distance ``radius`` or
less differ in at most ``radius`` groups and so agree exactly in ``bands - radius`` of them. Every
choice of that many groups is one projection of the grid, and its cells are joined on equality:
no neighbouring cell has to be probed. In a cell the Manhattan bound is checked first, then the
fingerprints themselves.

Work grows with the number of different fingerprints. Copies are one fingerprint. Cells of more
than ``cell_rows`` points (a large family of near copies) are not paired: their fingerprints go
through midpoints. Two fingerprints are at distance 4 or less exactly if some 64-bit value is
within 2 of both, and at most 2,081 values can share one, so each links to the least fingerprint at
each of its midpoints: linear in the family's size, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import measured_broadcasts, stored, utf8

SHINGLE = 4
SEED = 42
RADIUS = 4
BANDS = 7
CELL_ROWS = 128
SEGMENTS = 32
EVEN_BITS = 0x5555555555555555
BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    span = min(shingle, len(words)) - 1
    pairs = zip(starts[: len(words) - span].tolist(), ends[span:].tolist())
    n = len(words) - span
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed long; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content, fp) of every row: fp is the fingerprint as a signed long, content a hash of the
    text. NULL and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t) for t in utf8(batch.column(2))]
            arrays = [batch.column(0), batch.column(1), pa.array(marks, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "content", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("content"), text.alias("text"))
    return rows.mapInArrow(run, "id long, content long, fp long")


def unary_popcounts(fp: Column) -> Column:
    """The embedding: two bits a segment, as many of them set as the segment has set bits."""
    even = F.lit(EVEN_BITS)
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(even).bitwiseOR(
        F.shiftleft(fp.bitwiseAND(high).bitwiseAND(even), 1))


def band_masks(bands: int, radius: int) -> list[int]:
    """One mask for each choice of ``bands - radius`` groups of segments, as signed longs."""
    bounds = [round(SEGMENTS * i / bands) for i in range(bands + 1)]
    groups = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(bounds, bounds[1:])]
    masks = [sum(chosen) for chosen in combinations(groups, bands - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def midpoint_masks(radius: int) -> list[int]:
    """All values with at most half of ``radius`` bits set, as signed longs."""
    masks = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near(a: str, b: str, radius: int) -> Column:
    """The Manhattan lower bound on the embeddings, then the exact distance."""
    bound = F.bit_count(F.col(f"{a}.at").bitwiseXOR(F.col(f"{b}.at"))) <= radius
    return bound & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= radius)


def links(points: DataFrame, radius: int = RADIUS, bands: int = BANDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b), a < b: links between the fingerprints of ``points`` (column fp, no repeats).

    The links are enough to join whatever is connected at ``radius``; within large families
    not every pair is listed. ``radius`` has to be even.
    """
    if radius % 2 or not 0 < radius < bands <= SEGMENTS:
        raise ValueError("radius must be even, and smaller than bands")
    masks = F.array(*[F.lit(m) for m in band_masks(bands, radius)])
    cells = points.select("fp", unary_popcounts(F.col("fp")).alias("at"))
    cells = cells.select("fp", "at", F.posexplode(masks).alias("band", "mask"))
    # Cells that meet under one hash only cost a comparison: every pair is verified.
    cells = cells.select("fp", "at", F.xxhash64("band", F.col("at").bitwiseAND(F.col("mask"))).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    sizes = stored(sizes.where("n > 1"))
    twos = sizes.where("n = 2 AND bit_count(a ^ b) <= %d" % radius).select("a", "b")
    more = cells.join(sizes.where("n > 2").select("cell", "n"), "cell")
    more = stored(more)
    few = more.where(F.col("n") <= cell_rows)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") < F.col("y.fp")) & near("x", "y", radius))
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    family = more.where(F.col("n") > cell_rows).select("fp").distinct()
    middles = F.array(*[F.lit(m) for m in midpoint_masks(radius)])
    stars = family.select("fp", F.explode(middles).alias("mask"))
    stars = stars.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("middle"))
    stars = stars.withColumn("a", F.min("fp").over(Window.partitionBy("middle")))
    stars = stars.where("a < fp").select("a", F.col("fp").alias("b"))
    return twos.unionByName(pairs).unionByName(stars).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over ``edges`` (a, b), for each node that has an edge.

    Large-star and small-star rounds: each links neighbours to the least of them, until
    nothing changes. A hub's minimum is taken map-side, and no adjacency list is built.
    """
    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    state = None
    while True:
        both = pairs.select("u", "v").union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stored(small.union(low.select("u", "m")).distinct())
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def members(docs: DataFrame, id_col: str, text_col: str, radius: int, bands: int, cell_rows: int) -> DataFrame:
    """(id, content, fp, root, component) of every row; root is the least fingerprint of the class."""
    marks = stored(fingerprints(docs, id_col, text_col))
    with measured_broadcasts(docs.sparkSession):
        points = stored(marks.groupBy("fp").agg(F.min("id").alias("least_id")))
        roots = connected(links(points.select("fp"), radius, bands, cell_rows))
        points = points.join(roots, points.fp == roots.node, "left")
        points = stored(points.select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
        component = points.groupBy("root").agg(F.min("least_id").alias("component"))
        points = stored(points.join(component, "root").select("fp", "root", "component"))
    return marks.join(points.hint("merge"), "fp")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
            bands: int = BANDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, fp, component): every row with the least id of its class of near-duplicates.

    Repeated rows give repeated rows. Rows with a NULL id are members like any other but give no
    class its id; the component is NULL only if all its members' ids are. Other columns of
    ``docs`` are not read, whatever their names. An empty table gives an empty result.
    """
    return members(docs, id_col, text_col, radius, bands, cell_rows).select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
             bands: int = BANDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The rows of ``docs``, one of each class: that with the least id (NULL ids last).

    Of rows with this id the least content hash decides, and of repeats of one text any one stays.
    Ids are ranked without the texts, which move once, in the join with the ids that stay. All
    columns come back as they were.
    """
    ids = members(docs, id_col, text_col, radius, bands, cell_rows).select("id", "content", "root")
    return first_of_class(docs, ids, id_col, text_col)


def first_of_class(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each root in ``ids`` (id, content, root), chosen as in ``keep_one``."""
    first = Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last(), "content")
    best = ids.withColumn("rank", F.row_number().over(first)).where("rank = 1").select("id", "content", "root")
    times = ids.groupBy("id", "content", "root").agg(F.count("*").alias("times"))
    same = [best[c].eqNullSafe(times[c]) for c in ("id", "content", "root")]
    best = best.join(times.hint("merge"), same).select(best.id, best.content, "times")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("content"),
                       F.struct("*").alias("row"))
    rows = rows.join(best, rows.id.eqNullSafe(best.id) & (rows.content == best.content)).select(
        rows.id, rows.content, "times", "row")
    repeats = Window.partitionBy("id", "content").orderBy("times")
    repeated = rows.where("times > 1").withColumn("rank", F.row_number().over(repeats)).where("rank = 1")
    return rows.where("times = 1").select("row.*").unionByName(repeated.select("row.*"))
