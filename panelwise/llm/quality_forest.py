"""Quality rules with an isolation forest on rule statistics.

Fixed rules (too few words, too many repeated passages) reject on their own. Everything else is
left to the forest: trees of random splits, grown on the rule statistics of labelled rows; rows
that few splits set apart are unlike the rest. The path length at which a row counts as an anomaly
is calibrated on all labelled rows.

The forest is fitted on at most ``POOL`` labelled rows, those with the least hash of the id; a tree
sees ``TREE_ROWS`` of them. Everything else covers all rows. Statistics come from whole texts.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import CONTINUED, SPACE, stored, utf8

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
POOL = 8192
TREES = 128
TREE_ROWS = 256
SEED = 7
#: Steps of the calibration histogram; scores lie between 0 and 1.
STEPS = 4096
#: Of the labelled good rows, the share that calibration may give up at most.
MOST_LOST = 0.002

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["x_symbols", "x_marks", "x_upper", "x_digits", "x_dup_lines", "x_repeats", "x_stutter", "x_word_length"]
#: Shares that running prose reaches without being odd; features measure what lies beyond, on a log scale.
TOLERATED = {"symbols": 0.05, "marks": 0.2, "upper": 0.15, "digits": 0.3, "dup_lines": 0.3, "repeats": 0.3, "stutter": 0.1}
WORD_LENGTHS = (3.5, 9.0)
#: Words (or lines) added to the base of a share, so that a short text's few odd words don't make it odd.
PRIOR = 20
STATS_SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in FEATURES)

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LETTERS = UPPER + UPPER.lower() + bytes(range(0x80, 0x100))
DIGITS = b"0123456789"
MARKS = b"!=_^~@\\/{}[]+"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for j in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
        mixed ^= mixed >> np.uint64(29)
    ordered = np.sort(mixed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice))
    seen: dict[tuple[bytes, ...], list[int]] = {}
    for i in at.tolist():  # equal hashes are confirmed by the words themselves
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    starts = np.array([i for found in seen.values() if len(found) > 1 for i in found], np.int64)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((np.cumsum(change) > 0).sum())


def statistics(text: bytes | None) -> tuple:
    """Rule counts and the forest's features of one text; all zero for NULL and empty texts."""
    text = text or b""
    words = text.split()
    if not words:
        return (0,) * len(COUNTS) + (0.0,) * len(FEATURES)
    without = lambda chars: len(text) - len(text.translate(None, chars))
    n = len(words)
    chars = len(text.translate(None, CONTINUED + SPACE))
    symbols, upper = without(SYMBOLS), without(UPPER)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    shares = {
        "symbols": symbols / (n + PRIOR), "marks": without(MARKS) / (n + PRIOR), "upper": upper / (without(LETTERS) + PRIOR),
        "digits": without(DIGITS) / (chars + PRIOR), "dup_lines": dup_lines / (len(lines) + PRIOR), "repeats": repeats / (n + PRIOR),
        "stutter": sum(map(operator.eq, words, words[1:])) / (n + PRIOR),
    }
    length = chars / n
    odd = max(WORD_LENGTHS[0] - length, length - WORD_LENGTHS[1], 0.0)
    beyond = [math.log1p(10.0 * max(share - TOLERATED[name], 0.0)) for name, share in shares.items()]
    return (n, chars, symbols, dup_lines, repeats, *beyond, math.log1p(odd))


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule counts, features) of every row, from whole texts."""
    names = ["id", *COUNTS, *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*[statistics(t) for t in utf8(batch.column(1))])) or [()] * (len(names) - 1)
            kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found, kinds)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id long, {STATS_SCHEMA}")


def mean_path(n: float) -> float:
    """Mean path length of a failed search in a random tree of n rows."""
    return 0.0 if n < 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Forest:
    """Trees as arrays of tree x node; a leaf is its own child. At most 2 x TREE_ROWS nodes a tree."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    depth: int
    norm: float
    most: float = float("inf")

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score between 0 and 1 of each row; 0.5 is ordinary."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, path in zip(self.feature, self.cut, self.left, self.right, self.path):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                node = np.where(x[rows, feature[node]] < cut[node], left[node], right[node])
            total += path[node]
        return np.exp2(-total / max(len(self.path), 1) / self.norm)


def grow(pool: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """Random trees on subsamples of ``pool``, each split at a uniform value of a uniform feature."""
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(pool))
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    grown = []
    for _ in range(trees if size > 1 else 0):
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append([0, 0.0, at, at, level + mean_path(len(rows))])
            spread = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 and level < depth else []
            if len(spread):
                f = int(rng.choice(spread))
                cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
                below = rows[:, f] < cut
                nodes[at][:4] = [f, cut, split(rows[below], level + 1), split(rows[~below], level + 1)]
            return at

        split(pool[rng.choice(len(pool), size, replace=False)], 0)
        grown.append(nodes)
    width = max((len(nodes) for nodes in grown), default=1)
    table = np.zeros((len(grown), width, 5))
    for t, nodes in enumerate(grown):
        table[t, : len(nodes)] = nodes
    whole = lambda i: table[:, :, i].astype(np.int32)
    return Forest(whole(0), table[:, :, 1], whole(2), whole(3), table[:, :, 4], depth, max(mean_path(size), 1.0))


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` (any columns beside the features) with the forest's anomaly score."""
    names = stats.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(names.index(f)).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
            score = pa.array(forest.score(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*names, "anomaly"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema)
    return stats.mapInArrow(run, f"{schema}, anomaly double")


def base_failed() -> F.Column:
    """The fixed rules."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def threshold(histogram: list[tuple[int, int, int]], most_lost: float = MOST_LOST) -> float:
    """The score beyond which rows are rejected, from (step, good rows, bad rows).

    Of the cuts that give up at most ``most_lost`` of the good rows, the one with the largest share
    of bad rows caught less share of good rows lost; the highest of equals, half way to the next lower
    score. Infinite if nothing is gained.
    """
    good, bad = sum(h[1] for h in histogram), sum(h[2] for h in histogram)
    best, cut, lost, caught = 0.0, math.inf, 0, 0
    ordered = sorted(histogram, reverse=True)
    for (step, g, b), below in zip(ordered, [*ordered[1:], (-1, 0, 0)]):
        lost, caught = lost + g, caught + b
        gain = caught / max(bad, 1) - lost / max(good, 1)
        if lost <= most_lost * good and gain > best:
            best, cut = gain, (step + below[0] + 1) / 2 / STEPS
    return cut


def fit(stats: DataFrame, labels: DataFrame, pool: int = POOL, trees: int = TREES, tree_rows: int = TREE_ROWS,
        seed: int = SEED) -> Forest:
    """A forest with its threshold.

    ``stats`` has id and features; ``labels`` has doc_id and quality (1 good, 0 bad, NULL: not used).
    Rows that the fixed rules reject neither grow nor calibrate the forest. What reaches the driver
    is ``pool`` rows and a histogram of STEPS rows. Without labelled rows nothing counts as an anomaly.
    """
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id"))
    marks = marks.agg(F.max("quality").alias("quality"))
    known = stats.join(marks, stats.id == marks._id).where(~base_failed())
    known = stored(known.select("id", "quality", *FEATURES))
    first = known.orderBy(F.xxhash64(F.lit(seed), "id"), "id", *FEATURES).limit(pool)
    rows = [tuple(r) for r in first.select(*FEATURES).collect()]
    forest = grow(np.array(rows, float).reshape(-1, len(FEATURES)), trees, tree_rows, seed)
    if rows:
        step = F.floor(F.col("anomaly") * STEPS)
        counts = scored(known, forest).groupBy(step.alias("step")).agg(
            F.sum(F.col("quality").cast("long")), F.sum(F.lit(1) - F.col("quality")))
        forest.most = threshold([tuple(r) for r in counts.collect()])
    return forest


def verdicts(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with anomaly, base_failed and kept: neither rejected by a fixed rule nor an anomaly."""
    most = F.lit(forest.most)
    return (scored(stats, forest).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < most)))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, rule counts, features, anomaly, base_failed, kept) of every row of ``docs``.

    NULL and empty texts have no words and fail. Repeated rows give repeated rows; NULL ids are
    judged and never labelled. Other columns are not read.
    """
    stats = stored(rule_statistics(docs))
    return verdicts(stats, fit(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Texts are not shuffled: rows are judged where they are read, with the fitted forest.
    """
    forest = fit(stored(rule_statistics(docs)), labels)
    place = docs.columns.index("text")
    fails = lambda s: s[0] < LEAST_WORDS or 100 * s[4] > MOST_REPEATED * s[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in utf8(batch.column(place))]
            x = np.array([s[len(COUNTS):] for s in found], float).reshape(-1, len(FEATURES))
            good = (forest.score(x) < forest.most) & ~np.array([fails(s) for s in found], bool)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
