"""Near-duplicates by the Jaccard similarity of word shingles: 0.8 or more, verified exactly.

Candidates are connected by their SimHash fingerprints (``simhash.links``: at most 4 differing bits, majority bits of the same
shingles), which find nearly equal texts; or, as these miss most pairs near 0.8, they share one of ``BANDS`` bands of
``ROWS`` minima (MinHash) of their five-word shingles: a pair at similarity s is
found by bands with probability 1 - (1 - s ** ROWS) ** BANDS, that is 0.9996 at 0.8. Every candidate pair is checked with the
hashes of all its shingles; linked texts are connected to classes by the rounds of ``simhash.connected``.

Equal texts are one point. A class of fingerprints counts as one more band. Bands of more than ``BAND_ROWS`` points (a
family, or texts that share a passage) are not paired, yet whatever all their pairs would connect is connected:

* In ``ROUNDS`` rounds the members of each such band that are not in the class of the band's pivot are checked against it. The
  next round's pivot is of another class. A band whose members are all of one class is done.
* Members of the bands that are left are joined by prefixes: of two similar sets, the first fifths in an order from rare to
  common shingles share one, and a passage that many texts hold is common. Only texts of different classes are paired, and only
  where enough shingles follow the shared one: from the first that two sets share on, there are at least as many as they share.

Texts without words are one class. NULL ids, repeats and the row that stays are those of ``simhash.keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import measured_broadcasts, stored, utf8
from panelwise.llm.simhash import connected, first_of_class, majority
from panelwise.llm.simhash import links as fingerprint_links

SHINGLE = 5
SEED = 42
BANDS = 20
ROWS = 5
BAND_ROWS = 8
ROUNDS = 2
BLOCK = 4096
#: Similarity that links, in tenths.
TENTHS = 8
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = np.random.default_rng(SEED + 1).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def all_shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 of all word shingles, repeats included; of all words together if there are fewer than a shingle's."""
    words = (text or b"").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different ones of ``all_shingles``."""
    return np.unique(all_shingles(text, shingle))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One hash for each band of minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[at : at + BLOCK] * FACTORS[:, None]).min(axis=1), out=least)
    least = least.reshape(BANDS, ROWS)
    return ((least ^ least >> np.uint64(29)) * PLACES).sum(axis=1, dtype=np.uint64).view(np.int64)


def texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(content, text) of every row; content is a hash of the text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.xxhash64(text).alias("content"), text.alias("text"))


def banded(rows: DataFrame) -> DataFrame:
    """(content, n, fp, bands) of every row; n is the number of different shingles, fp the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, marks, found = [], [], []
            for text in utf8(batch.column(1)):
                hashes = all_shingles(text)
                different = np.unique(hashes)
                n.append(len(different))
                marks.append(majority(hashes))
                found.append(bands(different))
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(marks, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["content", "n", "fp", "bands"])

    return rows.mapInArrow(run, "content long, n long, fp long, bands array<long>")


def sets(rows: DataFrame) -> DataFrame:
    """(content, hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t).view(np.int64) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["content", "hashes"])

    return rows.mapInArrow(run, "content long, hashes array<long>")


def _alike(n: str, m: str, tenths: int) -> F.Column:
    """Do the sizes allow this similarity?"""
    return 10 * F.least(n, m) >= tenths * F.greatest(n, m)


def _pairs(few: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of contents in the same cell whose sizes allow the similarity."""
    x, y = few.alias("x"), few.alias("y")
    both = (F.col("x.band") == F.col("y.band")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.content") < F.col("y.content"))
    return x.join(y, both & _alike("x.n", "y.n", TENTHS)).select(F.col("x.content").alias("a"), F.col("y.content").alias("b")).distinct()


def _verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b) of the pairs that are similar enough."""
    x, y = found.select(F.col("content").alias("a"), F.col("hashes").alias("x")), found.select(F.col("content").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.where(10 * F.col("common") >= TENTHS * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b")


def _prefix_pairs(members: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): contents of ``members`` (content, root) of different roots that share one of their rarest shingles."""
    each = found.join(members, "content").select("content", "root", F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    often = each.groupBy("hash").agg(F.count("*").alias("often")).where("often > 1")
    listed = F.sort_array(F.collect_list(F.struct("often", "hash")))
    ordered = each.join(often, "hash").groupBy("content", "root", "n").agg(listed.alias("shared"))
    # Shingles of one text only come first and are in no other prefix: the prefix of the shared ones is shorter by their number.
    length = F.col("n") - F.ceil(F.col("n") * TENTHS / 10) + 1 - (F.col("n") - F.size("shared"))
    first = ordered.where(length > 0).select("content", "root", "n", F.size("shared").alias("all"),
                                             F.posexplode(F.slice("shared", F.lit(1), length.cast("int"))).alias("at", "s"))
    first = stored(first.select("content", "root", "n", (F.col("all") - F.col("at")).alias("rest"), F.col("s.hash").alias("hash")))
    # Of each shingle's texts those outside its most frequent class meet all others: a family does not meet itself.
    classes = first.groupBy("hash", "root").agg(F.count("*").alias("size"))
    top = classes.groupBy("hash").agg(F.max(F.struct("size", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    mixed = stored(first.join(top.select("hash", F.col("top.root").alias("most")), "hash"))
    x, y = mixed.where("root <> most").alias("x"), mixed.alias("y")
    both = (F.col("x.hash") == F.col("y.hash")) & (F.col("x.root") != F.col("y.root")) & _alike("x.n", "y.n", TENTHS)
    both &= (10 + TENTHS) * F.least("x.rest", "y.rest") >= TENTHS * (F.col("x.n") + F.col("y.n"))
    return x.join(y, both).select(F.least("x.content", "y.content").alias("a"), F.greatest("x.content", "y.content").alias("b")).distinct()


def _rooted(cells: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells with more than one class, each row with its class under ``links`` as ``root``; and a link of each text to its class's root."""
    roots = stored(connected(links))
    rows = stored(cells.join(roots, cells.content == roots.node, "left").select("band", "cell", "content", "n", F.coalesce("root", "content").alias("root")))
    open_ = rows.groupBy("band", "cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return rows.join(open_.select("band", "cell"), ["band", "cell"]), roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _large_links(cells: DataFrame, found: DataFrame, known: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): links that connect what ``known`` ones and all pairs in the cells (band, cell, content, n) would connect.

    Between rounds the links of a class shrink to one a text.
    """
    links, rows = known, cells.withColumn("root", F.col("content"))
    for k in range(rounds):
        # a second pivot of the same class as the first would find little that is new
        by = F.struct("root", "content", "n") if k % 2 else F.struct(-F.col("root"), "content", "n")
        pivots = rows.groupBy("band", "cell").agg(F.max(by).alias("p")).select("band", "cell", F.col("p.content").alias("pivot"), F.col("p.n").alias("m"))
        own = rows.select("content", F.col("root").alias("pivot_root")).distinct()
        pivots = pivots.join(own, pivots.pivot == own.content).drop("content")
        faced = rows.join(pivots, ["band", "cell"]).where((F.col("root") != F.col("pivot_root")) & _alike("n", "m", TENTHS))
        pairs = faced.select(F.least("content", "pivot").alias("a"), F.greatest("content", "pivot").alias("b")).distinct()
        rows, links = _rooted(cells, links.union(_verified(pairs, found)))
    left = stored(rows.select("content", "root").distinct())
    return links.union(_verified(stored(_prefix_pairs(left, found)), found))


def links(rows: DataFrame, band_rows: int = BAND_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): links between the contents of ``rows`` (content, text), enough to connect whatever the pairs of bands and fingerprint classes connect."""
    points = stored(banded(rows).groupBy("content").agg(*[F.first(c).alias(c) for c in ("n", "fp", "bands")]))
    roots = connected(fingerprint_links(points.select("fp").distinct()))
    marked = points.join(roots, points.fp == roots.node, "left").select("content", "n", F.lit(BANDS).alias("band"), F.coalesce("root", "fp").alias("cell"))
    cells = points.select("content", "n", F.posexplode("bands").alias("band", "cell")).unionByName(marked)
    many = cells.groupBy("band", "cell").agg(F.count("*").alias("members")).where("members > 1")
    cells = stored(cells.join(many, ["band", "cell"]))
    pairs = stored(_pairs(cells.where(F.col("members") <= band_rows)))
    large = cells.where(F.col("members") > band_rows).select("band", "cell", "content", "n")
    wanted = pairs.select(F.col("a").alias("content")).union(pairs.select("b")).union(large.select("content")).distinct()
    found = stored(sets(rows.join(wanted, "content", "left_semi").groupBy("content").agg(F.first("text").alias("text"))))
    few = stored(_verified(pairs, found))
    return few if large.isEmpty() else _large_links(large, found, few, rounds)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band_rows: int = BAND_ROWS) -> DataFrame:
    """The rows of ``docs``, one of each class, as ``simhash.keep_one`` chooses it."""
    with measured_broadcasts(docs.sparkSession):
        roots = stored(connected(links(texts(docs, text_col), band_rows)))
    text = F.col(text_col).cast("string")
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("content"))
    ids = ids.join(roots.hint("merge"), ids.content == roots.node, "left").select("id", "content", F.coalesce("root", "content").alias("root"))
    return first_of_class(docs, ids, id_col, text_col)
