"""Exact top-k search over 64-bit codes by incremental multi-index hashing.

A code is cut into ``m`` segments (about log2 of the number of different codes wide, so that buckets
hold few codes), each indexed by its value. Step s probes the buckets at exactly s differing bits in a
segment. After step s every code within ``m * (s + 1) - 1`` bits has been met, for with more than s
differing bits in each segment it would be farther. A query is finished as soon as its kth verified
distance is within that bound; the others go on with the next radius. So results are exact, ties
included (lesser id first).

Copies are one code: of its ids the k + 1 least are enough, as no other can be among k neighbours. A
pair is met once, in the first segment with s differing bits when no segment has fewer, so pairs need
no deduplication. Queries with one code are searched once.

Defined results: a NULL vector has no code (it is neither found nor searched for), missing components
are 0 bits and NULL ones too, NULL ids are left out, repeated rows count once (an id with several
codes is found under each), a query never finds its own id, fewer than k other ids give fewer
rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import stored

BITS = 64
K = 10
FOUND = "code long, distance int, id long"


def sign_code(vector: Column) -> Column:
    """Bit i of 64 is set if component i is positive; the last component is the lowest bit."""
    first = F.slice(vector, 1, BITS)
    code = F.aggregate(first, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))
    return F.when(vector.isNotNull(), code)


def widths(n: int) -> list[int]:
    """Segment widths for n different codes."""
    m = max(2, min(16, round(BITS / max(math.log2(max(n, 2)), 1))))
    bounds = [round(BITS * i / m) for i in range(m + 1)]
    return [b - a for a, b in zip(bounds, bounds[1:])]


def segment(code: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1))


def probes(spark, sizes: list[int], s: int) -> DataFrame:
    """(seg, mask): all ways to flip s bits of a segment."""
    rows = [(j, sum(1 << b for b in bits)) for j, w in enumerate(sizes) for bits in combinations(range(w), s)]
    return spark.createDataFrame(rows, "seg int, mask long")


def segments(codes: DataFrame, sizes: list[int]) -> DataFrame:
    """(code, seg, value)."""
    at = [sum(sizes[:j]) for j in range(len(sizes))]
    values = F.array(*[segment(F.col("code"), a, w) for a, w in zip(at, sizes)])
    return codes.select("code", F.posexplode(values).alias("seg", "value"))


def least_ids(points: DataFrame, k: int) -> DataFrame:
    """(code, id): the k least ids of each code. Ranks are cut before the shuffle as well."""
    order = Window.partitionBy("code").orderBy("id")
    return points.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def neighbours(points: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest other ids for each row of ``queries``; both have (id, code)."""
    spark = points.sparkSession
    points = points.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code")
    queries = stored(queries.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct())
    near = stored(least_ids(points, k + 1))
    codes = stored(near.select("code").distinct())
    sizes = widths(codes.count())
    index = stored(segments(codes, sizes))
    active = stored(queries.select("code").distinct())
    best, done, s = spark.createDataFrame([], FOUND), [], 0
    at = [sum(sizes[:j]) for j in range(len(sizes))]
    while not active.isEmpty():
        flips = F.broadcast(probes(spark, sizes, s)) if s <= max(sizes) else None
        wanted = segments(active, sizes).join(flips, "seg").select(
            F.col("code").alias("q"), "seg", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        differ = F.col("q").bitwiseXOR(F.col("code"))
        apart = [F.bit_count(segment(differ, a, w)) for a, w in zip(at, sizes)]
        first = F.lit(None).cast("int")
        for j in reversed(range(len(sizes))):
            first = F.when(apart[j] == s, F.lit(j)).otherwise(first)
        once = (F.col("seg") == first) & (F.least(*apart) >= s)
        met = wanted.join(index, ["seg", "value"]).where(once).select("q", "code", F.bit_count(differ).alias("distance"))
        met = met.join(near, "code").select(F.col("q").alias("code"), "distance", "id")
        order = Window.partitionBy("code").orderBy("distance", "id")
        best = best.unionByName(met).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).drop("rank")
        best = stored(best)
        bound = len(sizes) * (s + 1) - 1
        sure = best.groupBy("code").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        sure = sure.where((F.col("n") > k) & (F.col("far") <= bound)).select("code")
        if bound >= BITS or s == max(sizes):
            sure = active
        done.append(best.join(sure, "code", "left_semi"))
        rest = stored(active.join(sure, "code", "left_anti"))
        best, active, s = best.join(rest, "code", "left_semi"), rest, s + 1
    found = spark.createDataFrame([], FOUND)
    for part in done:
        found = found.unionByName(part)
    own = queries.withColumnRenamed("id", "query_id").join(found, "code").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
