"""Random forests on binned columns, grown data-parallel, with bags that are known outside of the fit.

Rows lie in blocks, by dense position; a row's weight in a tree is a Poisson(1) count hashed from seed, tree and position, so any
task can tell the rows a tree has not seen. Columns are cut into at most ``BINS`` bins. A level of all trees is grown
from sums by (tree, node, column, bin): tasks add up a block for some trees, the sums are added by tree, and the best split of
each node goes to the driver. A table of at most ``WHOLE_BLOCKS`` blocks needs no such rounds: a task gathers them, a few bytes a row, and grows
whole trees.

All sums are of whole numbers (targets are scaled to them), so that neither partitions nor order show in a forest.
The driver holds the trees: at most 2^(depth + 1) nodes each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.functions.hashing import MASK_32, POISSON_1_CDF, TWO_32, mix_bits, mix_seed, mix_step

BINS = 64
BLOCK = 65_536
#: Blocks and bytes that a task gathers at most (8 million rows, whatever the table's size), the bytes of a row beside its bins, and rows
#: whose weights are added up at a time.
WHOLE_BLOCKS = 128
WHOLE_BYTES = 1 << 28
ROW_BYTES = 12
AT_ONCE = 1 << 20
#: The least 32-bit numbers that stand for 1, 2, ... draws.
POISSON_STEPS = [math.ceil(c * TWO_32) for c in POISSON_1_CDF]
#: Numeric targets become whole numbers from 0 to this.
TARGET_STEPS = 1 << 20


@dataclass
class Trees:
    """Trees as arrays (tree x node); children of node i are ``left`` and ``left + 1``, -1 at leaves; ``value`` is the mean target vector."""

    feature: list[np.ndarray]
    cut: list[np.ndarray]
    left: list[np.ndarray]
    value: list[np.ndarray]


def bag(seed: int, tree: int, positions: np.ndarray) -> np.ndarray:
    """How often each row is drawn for a tree."""
    at = positions.astype(np.uint64)
    bits = mix_bits(mix_step(mix_seed(seed), tree, 0), ((at ^ (at >> np.uint64(32))) & np.uint64(MASK_32)).astype(np.uint32), 1)
    out, left = (bits >= np.uint32(POISSON_STEPS[0])).astype(np.int64), np.flatnonzero(bits >= np.uint32(POISSON_STEPS[1]))
    for step in POISSON_STEPS[1:]:
        if step >= TWO_32 or not len(left):
            break
        left = left[bits[left] >= np.uint32(step)]
        out[left] += 1
    return out


def _offered(seed: int, tree: int, nodes: np.ndarray, features: int, tried: int) -> np.ndarray:
    """The columns each node may split on (node x tried), by hash."""
    state = np.uint64(mix_step(mix_seed(seed + 1), tree, 0))
    keys = mix_step(mix_step(state, nodes.astype(np.uint64)[:, None], 1), np.arange(features, dtype=np.uint64)[None, :], 2)
    return np.sort(np.argsort(keys, axis=1, kind="stable")[:, :tried], axis=1)


def level_sums(codes: np.ndarray, target: np.ndarray, weight: np.ndarray, slot: np.ndarray, offered: np.ndarray, bins: int) -> np.ndarray:
    """Sums (slot x tried column x bin x (weight, targets)) of the rows whose node is open; slot -1: closed."""
    use = np.flatnonzero((slot >= 0) & (weight > 0))
    slots, tried = offered.shape
    k = target.shape[1]
    out = np.empty((slots, tried, bins, k + 1), np.int64)
    slot, weight = slot[use], weight[use].astype(float)
    values = [weight, *(weight * target[use, c] for c in range(k))]
    for j in range(tried):
        cell = slot * bins + codes[use, offered[:, j][slot]]
        for c, v in enumerate(values):  # whole numbers below 2 ** 53
            out[:, j, :, c] = np.bincount(cell, v, slots * bins).reshape(slots, bins)
    return out


def level_totals(target: np.ndarray, weight: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
    """Sums (slot x (weight, targets)) of the rows whose node is open."""
    use = slot >= 0
    weight = weight[use].astype(float)
    values = [weight, *(weight * target[use, c] for c in range(target.shape[1]))]
    return np.column_stack([np.bincount(slot[use], v, slots) for v in values]).astype(np.int64)


def best_splits(sums: np.ndarray, offered: np.ndarray, smallest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column or -1, last bin that goes left, totals) of each slot: the cut that leaves least squared error, first of equal ones."""
    total = sums[:, 0].sum(axis=1)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    n_left, n_right = left[..., 0].astype(float), right[..., 0].astype(float)
    score = (left[..., 1:].astype(float) ** 2).sum(-1) / np.maximum(n_left, 1) + (right[..., 1:].astype(float) ** 2).sum(-1) / np.maximum(n_right, 1)
    score = np.where((n_left >= smallest) & (n_right >= smallest), score, -np.inf)
    flat = score.reshape(len(sums), -1)
    best = flat.argmax(axis=1)
    whole = (total[:, 1:].astype(float) ** 2).sum(1) / np.maximum(total[:, 0], 1)
    gains = flat[np.arange(len(flat)), best] > whole * (1 + 1e-12)
    column, at = np.divmod(best, left.shape[2])
    return np.where(gains, offered[np.arange(len(offered)), column], -1), at, total


class Growing:
    """One tree while it grows: arrays, and the open nodes of the present level in order (their slots)."""

    def __init__(self, seed: int, tree: int, features: int, tried: int, depth: int, smallest: int):
        self.seed, self.tree, self.features, self.tried, self.depth, self.smallest = seed, tree, features, tried, depth, smallest
        self.feature, self.cut, self.left, self.value = [-1], [0], [-1], [None]
        self.open, self.level = np.array([0]), 0

    def offered(self) -> np.ndarray:
        return _offered(self.seed, self.tree, self.open, self.features, self.tried)

    def split(self, column: np.ndarray, at: np.ndarray, total: np.ndarray) -> None:
        """Close the level: nodes that split get children, all get values."""
        fresh = []
        for node, c, b, sums in zip(self.open.tolist(), column.tolist(), at.tolist(), total):
            self.value[node] = sums[1:] / max(sums[0], 1)
            if c >= 0 and self.level < self.depth:
                self.feature[node], self.cut[node], self.left[node] = c, b, len(self.left)
                for _ in range(2):
                    fresh.append(len(self.left))
                    self.feature.append(-1), self.cut.append(0), self.left.append(-1), self.value.append(None)
        self.open, self.level = np.array(fresh, int), self.level + 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left)

    def slots(self, codes: np.ndarray) -> np.ndarray:
        """The slot of each row's node, -1 where it has ended in a leaf of an earlier level."""
        node = descend(codes, *self.arrays(), self.level)
        slot = np.full(len(self.left), -1)
        slot[self.open] = np.arange(len(self.open))
        return slot[node]


def descend(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row after ``depth`` levels; who has reached a leaf stays there."""
    ended = feature < 0
    feature, cut, left = np.where(ended, 0, feature), np.where(ended, 255, cut).astype(np.uint8), np.where(ended, np.arange(len(left)), left)
    node, flat, start = np.zeros(len(codes), int), codes.reshape(-1), np.arange(len(codes)) * codes.shape[1]
    for _ in range(depth):
        if ended.take(node).all():
            break
        node = left.take(node) + (flat.take(start + feature.take(node)) > cut.take(node))
    return node


@dataclass
class Whole:
    """The known rows of a table: those of the same bins (and class, if targets are classes) share an entry."""

    at: np.ndarray
    #: The entry of each row; None: its own.
    entry: np.ndarray | None
    codes: np.ndarray
    #: The class of each entry of ``classes`` ones, or targets by row.
    own: np.ndarray | None
    classes: int
    target: np.ndarray | None


def packed(rows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(positions, codes, targets, classes) of a block's known rows, in as few bytes as they need; targets are classes if each row has one."""
    at, codes, target = (part[rows[3]] for part in rows[:3])
    k, small = target.shape[1], 1 << 31
    if 1 < k <= 256 and ((target == 0) | (target == 1)).all() and (target.sum(axis=1) == 1).all():
        target, classes = target.argmax(axis=1).astype(np.uint8), k
    else:
        target, classes = target if (np.abs(target) >= small).any() else target.astype(np.int32), 0
    return at if (at >= 2 * small).any() or (at < 0).any() else at.astype(np.uint32), codes, target, classes


def gathered(blocks: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> Whole:
    """All packed blocks together."""
    classes = blocks[0][3] if all(b[3] for b in blocks) else 0
    at, codes = (np.concatenate([b[i] for b in blocks]) for i in range(2))
    target = np.concatenate([b[2] if classes or not b[3] else (b[2][:, None] == np.arange(b[3])).astype(np.int32) for b in blocks])
    columns = [*codes.T, target] if classes else [*codes.T]
    sizes = [int(c.max()) + 1 if len(c) else 1 for c in columns]
    entry, own = None, target if classes else None
    if math.prod(sizes) < 1 << 62:
        key = np.zeros(len(at), np.int64)
        for c, size in zip(columns, sizes):
            key *= size
            key += c
        entry, different = pd.factorize(key)
        found = []
        for size in reversed(sizes):
            different, digit = np.divmod(different, size)
            found.append(digit.astype(np.uint8))
        found.reverse()
        entry, codes, own = entry.astype(np.int32), np.column_stack(found[: codes.shape[1]]), found[-1] if classes else None
    return Whole(at, entry, codes, own, classes, None if classes else target)


def whole_tree(tree: Growing, rows: Whole, bins: int) -> None:
    """Grow all levels; entries stay with their nodes from level to level."""
    n, width, k = len(rows.codes), rows.codes.shape[1], rows.classes
    sums = np.zeros((1 if k else 1 + rows.target.shape[1], n))
    for start in range(0, len(rows.at), AT_ONCE):
        part = slice(start, start + AT_ONCE)
        weight = bag(tree.seed, tree.tree, rows.at[part]).astype(float)
        values = [weight, *(weight * rows.target[part, c] for c in range(len(sums) - 1))]
        for total, v in zip(sums, values):  # whole numbers below 2 ** 53
            if rows.entry is None:
                total[part] = v
            else:
                total += np.bincount(rows.entry[part], v, n)
    use = np.flatnonzero(sums[0])
    codes, values, own = rows.codes[use], [v[use] for v in sums], rows.own[use] if k else None
    slot = np.zeros(len(use), int)

    def added(cell: np.ndarray, cells: int) -> np.ndarray:
        if not k:
            return np.column_stack([np.bincount(cell, v, cells) for v in values]).astype(np.int64)
        found = np.bincount(cell * k + own, values[0], cells * k).reshape(cells, k)
        return np.column_stack([found.sum(axis=1), found]).astype(np.int64)

    while len(tree.open):
        slots = len(tree.open)
        if tree.level == tree.depth:
            none = np.full(slots, -1)
            tree.split(none, none, added(slot, slots))
            break
        flat, start, offered = codes.reshape(-1), np.arange(len(slot)) * width, tree.offered()
        tables = [added(slot * bins + flat.take(start + column.take(slot)), slots * bins).reshape(slots, bins, -1) for column in offered.T.copy()]
        column, cut, total = best_splits(np.stack(tables, axis=1), offered, tree.smallest)
        tree.split(column, cut, total)
        inner = column >= 0
        stays = inner.take(slot)
        if not stays.all():
            codes, slot, values, own = codes[stays], slot[stays], [v[stays] for v in values], own[stays] if k else None
            flat, start = codes.reshape(-1), np.arange(len(slot)) * width
        slot = 2 * (np.cumsum(inner) - 1).take(slot) + (flat.take(start + column.take(slot)) > cut.take(slot))


def _row(batch: pa.RecordBatch, features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, codes, targets, known) of each block in a batch."""
    for at, codes, target, known in zip(*(batch.column(c) for c in ("at", "codes", "target", "known"))):
        at = at.values.to_numpy()
        target = np.frombuffer(target.as_py(), np.int64).reshape(len(at), -1)
        yield at, np.frombuffer(codes.as_py(), np.uint8).reshape(len(at), features), target, np.frombuffer(known.as_py(), bool)


def grow(
    blocks: DataFrame, features: int, trees: int, seed: int, depth: int, smallest: int, tried: int, bins: int = BINS, n_blocks: int | None = None,
    n_rows: int | None = None,
) -> Trees:
    """A forest on ``blocks``: (at, codes, target, known), for each block the rows' positions, and as bytes their bins
    (a byte each, row by row), target vectors (64-bit whole numbers) and whether they are known; other rows are not used.
    """
    n_blocks = blocks.count() if n_blocks is None else n_blocks
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    # Few blocks are dealt to tasks once for each group of trees; many stay where they are and see all trees.
    whole_ = n_blocks <= WHOLE_BLOCKS and (n_rows or n_blocks * BLOCK) * (features + ROW_BYTES) <= WHOLE_BYTES
    parallel = -(-trees // (2 * cores)) if whole_ else trees if n_blocks >= cores else -(-trees * n_blocks // (2 * cores))
    groups = [list(range(i, min(i + parallel, trees))) for i in range(0, trees, parallel)]
    made = [Growing(seed, t, features, tried, depth, smallest) for t in range(trees)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _row(batch, features):
                *parts, classes = packed(rows)
                columns = [*[pa.array([x.tobytes()], pa.binary()) for x in parts], *[pa.array([x], pa.string()) for x in (parts[0].dtype.str, parts[2].dtype.str)], pa.array([classes], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["at", "codes", "target", "at_kind", "kind", "classes"])

    def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        for at, codes, target, at_kind, kind, classes in zip(*(batch.column(c).to_pylist() for c in ("at", "codes", "target", "at_kind", "kind", "classes"))):
            at, codes, target = np.frombuffer(at, at_kind), np.frombuffer(codes, np.uint8).reshape(-1, features), np.frombuffer(target, kind)
            yield at, codes, target if classes else target.reshape(len(at), -1) if len(at) else np.empty((0, 1), kind), classes

    if whole_:
        blocks = blocks.mapInArrow(pack, "at binary, codes binary, target binary, at_kind string, kind string, classes int")
    dealt = blocks.select("*", F.explode(F.array(*[F.lit(i) for i in range(len(groups))])).alias("group"))
    if len(groups) > 1:
        dealt = dealt.repartition(2 * len(groups), "group")

    def sums_of(tree: Growing, rows: tuple) -> np.ndarray:
        at, codes, target, known = rows
        weight, slot, offered = bag(seed, tree.tree, at[known]), tree.slots(codes[known]), tree.offered()
        if tree.level < depth:
            return level_sums(codes[known], target[known], weight, slot, offered, bins)
        last = np.zeros((*offered.shape, bins, target.shape[1] + 1), np.int64)
        last[:, 0, 0] = level_totals(target[known], weight, slot, len(offered))  # leaves need no cuts
        return last

    if whole_:
        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, held = [], []
            for batch in batches:
                for i, group in enumerate(batch.column("group").to_pylist()):
                    own += [group] if group not in own else []
                    if group == own[0]:  # all groups have the same blocks
                        held += unpacked(batch.slice(i, 1))
            if not held:
                return
            rows = gathered(held)
            held.clear()
            for t in (t for group in own for t in groups[group]):
                tree = Growing(seed, t, features, tried, depth, smallest)
                whole_tree(tree, rows, bins)
                f, c, left = (pa.array([x], pa.list_(pa.int32())) for x in tree.arrays())
                value = pa.array([np.concatenate(tree.value)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), f, c, left, value], ["tree", "f", "c", "l", "v"])

        found = dealt.mapInArrow(whole, "tree int, f array<int>, c array<int>, l array<int>, v array<double>").collect()
        ordered = sorted(found, key=lambda r: r.tree)
        return Trees(*[[np.array(r[k]) for r in ordered] for k in ("f", "c", "l")],
                     [np.array(r.v).reshape(len(r.f), -1) for r in ordered])

    def sums(now: list[Growing]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, group in zip(_row(batch, features), batch.column("group").to_pylist()):
                    for t in groups[group]:
                        if len(now[t].open):
                            found = sums_of(now[t], rows)
                            flat = found.reshape(-1, found.shape[-1])
                            cell = np.flatnonzero(flat[:, 0])
                            if not len(cell):
                                continue
                            yield pa.RecordBatch.from_arrays([
                                pa.array([t], pa.int32()), pa.array([cell], pa.list_(pa.int64())),
                                pa.array([flat[cell].ravel()], pa.list_(pa.int64()))], ["tree", "cell", "sums"])

        return run

    def choose(now: list[Growing]):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            tree = now[key[0].as_py()]
            offered = tree.offered()
            cells = offered.size * bins
            total = None
            for cell, values in zip(table.column("cell"), table.column("sums")):
                at = cell.values.to_numpy()
                values = values.values.to_numpy().reshape(len(at), -1)
                total = np.zeros((cells, values.shape[1]), np.int64) if total is None else total
                total[at] += values
            column, at, whole = best_splits(total.reshape(*offered.shape, bins, -1), offered, smallest)
            return pa.table({"tree": pa.array([tree.tree], pa.int32()), "column": pa.array([column], pa.list_(pa.int64())),
                             "at": pa.array([at], pa.list_(pa.int64())), "total": pa.array([whole.ravel()], pa.list_(pa.int64()))})

        return run

    while any(len(t.open) for t in made):
        each = dealt.mapInArrow(sums(made), "tree int, cell array<long>, sums array<long>")
        found = each.groupBy("tree").applyInArrow(choose(made), "tree int, column array<long>, at array<long>, total array<long>").collect()
        for r in found:
            made[r.tree].split(np.array(r.column), np.array(r["at"]), np.array(r.total).reshape(len(r.column), -1))
        for t in set(range(trees)) - {r.tree for r in found}:
            if len(made[t].open):  # no row of the bag is known
                width = len(found[0].total) // len(found[0].column) if found else 2
                made[t].split(np.array([-1]), np.array([0]), np.zeros((1, width), np.int64))
    return Trees(*[[x for x in t] for t in zip(*(t.arrays() for t in made))], [np.array(t.value) for t in made])


def predict(forest: Trees, codes: np.ndarray, at: np.ndarray | None = None, seed: int = 0, depth: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(mean target vectors, trees that spoke) of each row; with positions, only trees whose bag left the row out speak."""
    total = np.zeros((len(codes), forest.value[0].shape[1] if forest.value else 1))
    spoke = np.zeros(len(codes), np.int64)
    for t in range(len(forest.feature)):
        use = np.flatnonzero(bag(seed, t, at) == 0) if at is not None else slice(None)
        total[use] += forest.value[t][descend(codes[use], forest.feature[t], forest.cut[t], forest.left[t], depth)]
        spoke[use] += 1
    return total / np.maximum(spoke, 1)[:, None], spoke


def scaled(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """Numbers as whole steps between low and high."""
    return np.rint((values - low) / ((high - low) or 1.0) * TARGET_STEPS).astype(np.int64)


def binned(values: np.ndarray, cuts: Sequence[float]) -> np.ndarray:
    return np.searchsorted(np.asarray(cuts, float), values, "left").astype(np.uint8)
