"""Periodic runs of words: stretches that repeat a unit of q words at least four times.

Seed and extend along diagonals. Two words q apart lie on diagonal q; a run of period q and n words
is a stretch of n - q matches there. A run of at least max(6, 4 q) words with q in [2^j, 2^(j+1)) has
max(5, 3 * 2^j) matches or more, so its two copies share a k-gram of that length: the index of level j
holds the k-grams of exactly this guaranteed overlap. k exceeds q, and so two neighbouring
occurrences of a k-gram inside one run are q apart (a smaller distance would be a smaller period of the run).
Hence it is enough to go through pairs of neighbouring occurrences, at most one a word and level. A
table holds how far each lag's diagonal is covered; pairs inside the covered part are not extended again.

k-grams are compared by names, not by hashes: the name of a long gram is the rank of the pair of names
of its two (overlapping) halves. No k-gram occurs twice beyond the level at which none does, so plain
prose ends at the first level.

Long texts cost words x levels; nothing is proportional to the number of pairs of equal k-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import utf8

LEAST_WORDS = 6
LEAST_REPEATS = 4
#: Texts go through Python in slices of about so many bytes, a text at least.
SLICE_BYTES = 1 << 20
RUNS = "array<struct<start: long, length: long, period: long>>"


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs: equal pairs get equal names."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def _overlap(low: int, least: int, repeats: int) -> int:
    """Matches that a run with a lag in [low, 2 low) has at least."""
    if low >= least:
        return (repeats - 1) * low
    return min(max(least - q, (repeats - 1) * q) for q in range(low, 2 * low))


def _levels(codes: np.ndarray, least: int, repeats: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(least lag, k, names of the k-grams at each word) of each level."""
    n, low = len(codes), 1
    grams = {1: codes}

    def name(k: int) -> np.ndarray:
        if k not in grams:
            half = max(h for h in grams if h < k)
            if 2 * half < k:
                half = -(-k // 2)
                name(half)
            grams[k] = _named(grams[half][: n - k + 1], grams[half][k - half : n - half + 1])
        return grams[k]

    while low * repeats <= n:
        k = _overlap(low, least, repeats)
        if k + low <= n:
            yield low, k, name(k)
        for h in [h for h in grams if 1 < h < k]:
            del grams[h]
        low *= 2


def _pairs(names: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(place, lag) of neighbouring occurrences with a lag in [low, 2 low), in order of place; does any gram occur twice?"""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    at, lag = order[:-1][same], np.diff(order)[same]
    fits = (lag >= low) & (lag < 2 * low)
    at, lag = at[fits], lag[fits]
    by_place = np.argsort(at, kind="stable")
    return at[by_place], lag[by_place], bool(same.any())


def _reach(codes: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many words from i on, in direction step, equal the word a lag further; in doubling strides."""
    n, done, stride = len(codes), 0, 16
    while True:
        if step > 0:
            a = codes[i + done : min(i + done + stride, n - lag)]
            b = codes[i + done + lag : min(i + done + stride, n - lag) + lag]
        else:
            low = max(i - done - stride + 1, 0)
            a, b = codes[low : max(i - done + 1, 0)][::-1], codes[low + lag : max(i - done + 1, 0) + lag][::-1]
        differ = a != b
        if differ.any():
            return done + int(differ.argmax())
        done += len(a)
        if len(a) < stride:
            return done
        stride *= 2


def _primitive(unit: np.ndarray) -> bool:
    """Is unit no repetition of a shorter one?"""
    q = rest = len(unit)
    p = 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = q // p
            if np.array_equal(unit[d:], unit[:-d]):
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def find_runs(words: list, least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start, then period.

    A run's period is its smallest one; its length is at least ``least`` words and ``repeats`` periods
    (3 or more of them, ``least`` above 2).
    """
    if len(words) < max(least, repeats):
        return []
    names: dict = {}
    codes = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    if len(names) == len(words):
        return []
    found = []
    for low, k, grams in _levels(codes, least, repeats):
        at, lags, twice = _pairs(grams, low)
        covered: dict[int, int] = {}
        for i, q in zip(at.tolist(), lags.tolist()):
            if i < covered.get(q, 0):
                continue
            start = i - _reach(codes, i - 1, q, -1) if i else 0
            matches = i - start + _reach(codes, i, q, 1)
            covered[q] = start + matches
            length = matches + q
            if length >= max(least, repeats * q) and _primitive(codes[start : start + q]):
                found.append((start, length, q))
        if not twice and k <= _overlap(2 * low, least, repeats):  # longer grams do not occur twice either
            break
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [w for w, depth in zip(words, np.cumsum(change).tolist()) if not depth]


def slices(batches: Iterator[pa.RecordBatch], place: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the strings of column ``place`` take about ``most`` bytes in each."""
    for batch in batches:
        sizes = np.array([len(t or b"") for t in utf8(batch.column(place))], np.int64)
        cut = (np.cumsum(sizes) - sizes) // most
        starts = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS,
         repeats: int = LEAST_REPEATS) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row, from whole texts.

    ``runs`` lists (start, length, period) in words, by start, then period; ``collapsed`` is the text's words joined
    by one space, without those that a run holds after its first period. NULL, empty and blank texts
    have no words, no runs and an empty ``collapsed``. Repeated rows give repeated rows, NULL ids stay;
    other columns are not read, whatever their names. Every row is found on its own: no shuffle.
    """
    if repeats < 3 or least < 3:
        raise ValueError("a run has 3 repeats and 3 words or more")
    names = ["id", "n_words", "runs", "collapsed"]
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = [(t or b"").split() for t in utf8(batch.column(1))]
            found = [find_runs(words, least, repeats) for words in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(map(len, texts), pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], pa.list_(item)),
                pa.array([b" ".join(collapsed(w, r)) for w, r in zip(texts, found)], pa.binary()).cast(pa.string()),
            ], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id long, n_words long, runs {RUNS}, collapsed string")


def strongest(column: F.Column) -> F.Column:
    """The run of greatest length/period, compared exactly; the first by start and period of equal ones; NULL if there is none."""
    ahead = lambda a, b: F.coalesce(b["length"] * a["period"] > a["length"] * b["period"], F.lit(True))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(column, none, lambda best, r: F.when(ahead(best, r), r).otherwise(best))
