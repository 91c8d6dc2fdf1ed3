"""Language-model scores by logistic context mixing, with unigram scores beside them.

A text is a string of bits: its lower-cased UTF-8 bytes, then an end byte (255, which UTF-8 never has). One
predictor for each of ``ORDERS`` looks up how often the last bytes and the bits of the current byte have been seen.
Predictions are stretched (log odds) and added under weights that a gate selects: the bit's place in its
byte and how often the longest context has been seen. The squashed sum is the probability of a one.

Contexts are known exactly: the last bytes with the current one are a number (a *gram*, 8 digits a byte), and
grams that begin alike are a stretch of numbers, so that a bit's counts are sums over a stretch. The table of grams grows with the
corpus and stays in Spark: rows are dealt to blocks of BLOCK bytes, a block names its different grams, their counts are summed over
all blocks, and each block is joined with the grams it needs. Only weights and frequent tokens reach the driver.

Weights are learned from all training bits at once, each bit's own count taken out: Newton steps on the cost of each gate's bits, over
the table of grams. While scoring, weights go on adapting inside each text, byte by byte: a bit is predicted with weights that have seen only
what stands before it, so the score is a probability. (A byte's bits have different gates, so a step for each byte is one for each bit.)
The texts of some pieces take their steps together, each with weights of its own.

Unigram scores: tokens with at least 1 / FREQUENT of all training tokens (so at most FREQUENT of them)
are looked up where the text is read; all others are counted for each row and joined with the corpus counts.

Defined results: NULL and empty texts have only the end; a row with a NULL id is held out, as the
checksum of nothing is 0; repeated rows train and score as often as they occur; without training rows the model
says one half for each bit and base_score is that of an empty count; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import copy_folder, dropped, short_shuffles, small_batches, stored, utf8
from panelwise.llm.periodic import slices

ORDERS = (1, 2, 3, 5)
PAD = ORDERS[-1]
#: A gram's order stands above its bytes.
TAG = 56
LONGEST = len(ORDERS) - 1
SLOT_BITS = 64
#: Bytes between the steps of the weights inside a text; texts that take them together, bytes of such texts, and steps whose costs are added up at once.
CHUNK = 1
TOGETHER = 4096
WAITING = 1 << 22
WINDOW = 64
SEEN = 4
RATE = 0.02
START_WEIGHT = 0.35
MOST = 8.0
FREQUENT = 20000
FLUSH = 200_000
HELD_OUT = 10
END = b"\xff"
BITS = np.arange(8)
GATES = 8 * SEEN
BYTES = np.arange(256)[:, None]
#: By byte: its bits, and each bit's place (a one and the bits before it).
ONES = (BYTES >> (7 - BITS)) & 1
NODES = ((1 << BITS) | (BYTES >> (8 - BITS))).astype(np.uint64)
#: Bytes of a block of texts, and of a piece of it that is worked on at once; grams that are gathered before they are merged.
BLOCK = 48 << 20
PIECE = 1 << 19
GATHERED = 1 << 21
#: Newton steps at most, the change that ends them, and the pull to the first weights.
STEPS = 20
CLOSE = 1e-6
PULL = 1.0
#: What a gram's eight bits bring: log odds of the bits as they are, and the steps of what has been seen before each.
LOOK = np.dtype([("x", "<f4", 8), ("seen", "u1", 8)])
ROW = "key long, doc_id long, held_out boolean, n_tokens long, known long, part double, score double, rest array<struct<token:binary,n:long>>"


def pieces(sizes: Sequence[int]) -> Iterator[slice]:
    """Places of texts of some PIECE bytes together; ``sizes`` are those of the texts."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        total += size + 1
        if total >= PIECE:
            yield slice(first, i + 1)
            first, total = i + 1, 0
    if first < len(sizes):
        yield slice(first, len(sizes))


def text_sizes(column: pa.ChunkedArray) -> list[int]:
    """Bytes of each text; none for NULL."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def packed(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The longest gram of each byte of the texts and their ends (zeros before a text), and how many each text has."""
    parts = [b"\0" * PAD + (t or b"").lower() + END for t in texts]
    sizes = np.array([len(p) - PAD for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    two = data[1:] | data[:-1] << 8
    all_ = two[4:] | two[2:-2] << 16 | two[:-4] << 32
    gaps = np.cumsum(sizes + PAD)[:-1] - PAD
    keep = np.ones(len(all_), bool)
    keep[(gaps[:, None] + np.arange(PAD)).ravel()] = False
    return all_[keep], sizes


def keyed(order: int, grams: np.ndarray) -> np.ndarray:
    """Grams of the longest order as keys of the order at this place of ORDERS."""
    return grams & ((1 << 8 * (ORDERS[order] + 1)) - 1) | (order << TAG)


def merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, with their sums."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(n[order], first)


def path_counts(keys: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How often each wanted gram's context was seen, alone and with the first 1 to 8 bits of its byte; ``keys`` are in order."""
    upto = np.concatenate([[0], np.cumsum(n)])
    out = np.empty((len(wanted), 9), np.int64)
    for j in range(9):
        low = wanted >> (8 - j) << (8 - j)
        out[:, j] = upto[np.searchsorted(keys, low + (1 << (8 - j)))] - upto[np.searchsorted(keys, low)]
    return out


def looks(paths: np.ndarray) -> np.ndarray:
    """LOOK of each row of path counts."""
    same, other = paths[:, 1:], paths[:, :-1] - paths[:, 1:]
    out = np.empty(len(paths), LOOK)
    out["x"] = np.clip(np.log((same + 0.2) / (other + 0.2)), -MOST, MOST)
    out["seen"] = np.minimum(np.log2(paths[:, :-1] + 1).astype(np.int64) // 2, SEEN - 1)
    return out


def gates(seen: np.ndarray) -> np.ndarray:
    """The gate of each bit (n x 8), from its place in the byte and the longest context's step."""
    return BITS * SEEN + seen


def first_weights() -> np.ndarray:
    return np.full((GATES, len(ORDERS)), START_WEIGHT)


def mix(inputs: list[np.ndarray], gate: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the bits as they are, and exp of minus their size: all that costs and errors need."""
    signed = sum(x * np.take(w, gate) for x, w in zip(inputs, weights.T.astype(np.float32)))
    return signed, np.exp(-np.abs(signed))


def nats(signed: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Cost of each bit."""
    return np.log1p(small) - np.minimum(signed, 0)


def wrong(signed: np.ndarray, small: np.ndarray) -> np.ndarray:
    """The probability that was given to the other bit."""
    return np.where(signed > 0, small, np.float32(1)) / (1 + small)


class Table:
    """What the longest grams of some texts (all different) bring: a row of inputs for each, by bit and order, and its steps of what has been seen."""

    def __init__(self, grams: np.ndarray, look: Callable[[np.ndarray], np.ndarray], weights: np.ndarray) -> None:
        """``look`` gives LOOK by key; ``weights`` are the learned ones."""
        self.grams, self.weights = pd.Index(grams), weights
        self.x = np.empty((len(grams), 8, len(ORDERS)), np.float32)
        for j in range(LONGEST):
            at, different = pd.factorize(keyed(j, grams))
            self.x[:, :, j] = look(different)["x"].take(at, axis=0)
        found = look(keyed(LONGEST, grams))
        self.x[:, :, LONGEST] = found["x"]
        self.seen = np.ascontiguousarray(found["seen"])
        del found


def adapted(at: np.ndarray, first: np.ndarray, sizes: np.ndarray, table: Table) -> np.ndarray:
    """What texts cost under weights that take a step along the gradient after each byte; the longest text comes first. ``at`` are
    places in ``table`` by byte, a text's from ``first`` on."""
    n, wide = len(sizes), len(ORDERS)
    # a gate's weights are 16 bytes: moved as one number
    weights = np.repeat(table.weights.astype(np.float32)[None], n, axis=0).reshape(-1).view(np.complex128)
    own, total = np.arange(n)[:, None] * GATES + BITS * SEEN, np.zeros(n)
    left = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # texts that are longer than this
    held, rate = np.empty((min(WINDOW, int(sizes[0])), n, 8), np.float32), np.float32(RATE)
    for start in range(0, int(sizes[0]), WINDOW):
        most, stop = int(left[start]), min(start + WINDOW, int(sizes[0]))
        window = held[: stop - start, :most]
        window.fill(np.inf)  # a bit that costs nothing, where a text has ended
        for t in range(start, stop):
            k = int(left[t])
            place = at[first[:k] + t]
            x = table.x.take(place, axis=0)
            gate = own[:k] + table.seen.take(place, axis=0)
            moved = weights.take(gate)
            w = moved.view(np.float32).reshape(k, 8, wide)
            signed = np.einsum("tbo,tbo->tb", x, w, out=window[t - start, :k])
            off = rate / (1 + np.exp(np.minimum(signed, 80)))
            x *= off[:, :, None]
            w += x
            weights[gate] = moved
        total[:most] += nats(window, np.exp(-np.abs(window))).sum(axis=(0, 2), dtype=np.float64)
    return total


def places(texts: Sequence[bytes | None], table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Where the grams of the texts (a piece) are in ``table``, which has all of them, and how many each text has."""
    grams, sizes = packed(texts)
    return table.grams.get_indexer(grams).astype(np.int32), sizes


def log10_scores(at: np.ndarray, sizes: np.ndarray, table: Table) -> np.ndarray:
    """log10 of the probability of each text and its end, from its ``places``."""
    first, order, totals = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable"), np.empty(len(sizes))
    for i in range(0, len(order), TOGETHER):
        some = order[i : i + TOGETHER]
        totals[some] = adapted(at, first[some], sizes[some], table)
    return -totals / math.log(10)


@dataclass
class Model:
    """Grams of all orders in order, their counts, and mixing weights: a model held in memory whole."""

    keys: np.ndarray
    n: np.ndarray
    weights: np.ndarray

    def prepare(self) -> Callable[[np.ndarray], np.ndarray]:
        return lambda wanted: looks(path_counts(self.keys, self.n, wanted))

    def log10(self, text: bytes | None, tables: Callable[[np.ndarray], np.ndarray]) -> float:
        """log10 of the probability of the text and its end; ``tables`` are those of ``prepare``."""
        table = Table(np.unique(packed([text])[0]), tables, self.weights)
        return float(log10_scores(*places([text], table), table)[0])

    def _by_slot(self) -> Iterator[tuple[tuple[int, int], int, int]]:
        """(order, slot of a bit, ones, all): slots are hashes of the context, changed by the bit's place."""
        for j, order in enumerate(ORDERS):
            keys = self.keys[self.keys >> TAG == j]
            paths, byte = path_counts(self.keys, self.n, keys), keys & 255
            h = np.zeros(len(keys), np.uint64)
            for back in range(1, order + 1):
                h = (h + (keys >> 8 * back & 255).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            ones = np.where(ONES[byte] == 1, paths[:, 1:], paths[:, :-1] - paths[:, 1:])
            for slot, o, a in zip((h[:, None] ^ NODES[byte]).ravel().tolist(), ones.ravel().tolist(), paths[:, :-1].ravel().tolist()):
                yield (j, slot), o, a

    @cached_property
    def ones(self) -> Counter:
        """Counts of ones by order and slot."""
        return Counter({at: o for at, o, _ in self._by_slot()})

    @cached_property
    def all(self) -> Counter:
        """Counts of all bits by order and slot."""
        return Counter({at: a for at, _, a in self._by_slot()})


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of one width as an Arrow column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def rows_of(column: pa.ChunkedArray | pa.Array, kind: np.dtype) -> np.ndarray:
    """The rows back, without a Python object for each."""
    out = [np.empty(0, kind)]
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(c):
            start = np.frombuffer(c.buffers()[1], np.int32)[c.offset]
            out.append(np.frombuffer(c.buffers()[2], kind, len(c), int(start)))
    return np.concatenate(out)


def blocks(rows: DataFrame) -> int:
    """How many blocks the texts of ``rows`` are dealt to."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // BLOCK))


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (doc_id, text, held_out) with their block; by content, so that each reading deals them alike."""
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


def block_grams(rows: DataFrame) -> DataFrame:
    """(block, key, n): the different grams of each block of ``rows`` (block, text, held_out), n of them in training texts."""

    def run(block: tuple, table: pa.Table) -> pa.Table:
        column, train = table.column("text"), ~table.column("held_out").to_numpy()
        keys, n, held = [], [], 0

        def gather() -> None:
            both = merged(np.concatenate(keys), np.concatenate(n))
            keys[:], n[:] = [both[0]], [both[1]]

        for place in pieces(text_sizes(column)):
            grams, sizes = packed(utf8(column[place]))
            marked = grams << 1 | np.repeat(train[place], sizes)
            marked.sort()
            first = np.flatnonzero(np.diff(marked, prepend=-1))
            found = marked[first]
            keys.append(found >> 1)
            n.append(np.diff(first, append=len(marked)) * (found & 1))
            held += len(found)
            if held > GATHERED:
                gather()
                held = 0
        gather()
        per = [merged(keyed(j, keys[0]), n[0]) for j in range(len(ORDERS))]
        key, count = np.concatenate([k for k, _ in per]), np.concatenate([c for _, c in per])
        return pa.table({"block": pa.array(np.full(len(key), block[0].as_py(), np.int32)), "key": key, "n": count})

    return rows.select("block", "text", "held_out").groupBy("block").applyInArrow(run, "block int, key long, n long")


def gram_table(found: DataFrame, n: int) -> DataFrame:
    """(key, n, look, own) of all different grams of ``found``: what each brings, and what it brings with its own count taken out."""

    def run(table: pa.Table) -> pa.Table:
        keys, count = merged(table.column("key").to_numpy(), table.column("n").to_numpy())
        paths = path_counts(keys, count, keys)
        return pa.table({"key": keys, "n": count, "look": binary(looks(paths)), "own": binary(looks(np.maximum(paths - 1, 0)))})

    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    # the grams of a context lie in one part
    part = F.pmod(F.xxhash64(F.shiftright("key", 8)), F.lit(n)).alias("part")
    return counts.select(part, "key", "n").groupBy("part").applyInArrow(lambda t: run(t), "key long, n long, look binary, own binary")


def learned_weights(grams: DataFrame) -> np.ndarray:
    """Weights of the least cost of all training bits, by damped Newton steps; a step that raises a gate's cost is halved."""
    rows = grams.where(f"n > 0 AND shiftright(key, {TAG}) = {LONGEST}").select("key", "n", F.col("own").alias(f"own{LONGEST}"))
    for j in range(LONGEST):
        mask = (1 << 8 * (ORDERS[j] + 1)) - 1
        shorter = grams.where(f"shiftright(key, {TAG}) = {j}").select(F.col("key").alias(f"key{j}"), F.col("own").alias(f"own{j}"))
        rows = rows.join(shorter, F.col("key").bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(j << TAG)) == F.col(f"key{j}"))
    folder = copy_folder(grams.sparkSession)
    rows = stored(rows.select("n", *[f"own{j}" for j in range(len(ORDERS))]), folder)
    size, wide = GATES, len(ORDERS)
    weights = first_weights()
    best, least = weights.copy(), np.full(size, np.inf)
    for _ in range(STEPS):
        now = weights.copy()

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((size, 1 + wide + wide * wide))
            for batch in batches:
                n = np.repeat(batch.column(0).to_numpy().astype(float), 8)
                found = [rows_of(batch.column(1 + j), LOOK) for j in range(wide)]
                xs, gate = [f["x"] for f in found], gates(found[-1]["seen"])
                signed, small = mix(xs, gate, now)
                at, flat = gate.ravel(), [x.ravel() for x in xs]
                off = wrong(signed, small).ravel()
                slope, bend = n * off, n * off * (1 - off)
                sums[:, 0] += np.bincount(at, n * nats(signed, small).ravel(), size)
                for j in range(wide):
                    sums[:, 1 + j] += np.bincount(at, slope * flat[j], size)
                    for k in range(j + 1):
                        sums[:, 1 + wide + wide * j + k] += np.bincount(at, bend * flat[j] * flat[k], size)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["i", "v"])

        sums = np.zeros(size * (1 + wide + wide * wide))
        for i, v in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect():
            sums[i] = v
        sums = sums.reshape(size, -1)
        change = 0.0
        for g in range(size):
            pull = now[g] - START_WEIGHT
            cost = sums[g, 0] + PULL / 2 * pull @ pull
            if cost <= least[g]:
                best[g], least[g] = now[g], cost
                h = sums[g, 1 + wide :].reshape(wide, wide)
                h = h + np.tril(h, -1).T + PULL * np.eye(wide)
                step = np.linalg.solve(h, sums[g, 1 : 1 + wide] - PULL * pull)
                weights[g] = now[g] + step / max(1.0, np.abs(step).max())
            else:
                weights[g] = (now[g] + best[g]) / 2
            change = max(change, np.abs(weights[g] - best[g]).max())
        if change < CLOSE:
            break
    dropped(grams.sparkSession, folder)
    return best


def fit(train: DataFrame) -> Model:
    """A model of all rows of ``train`` (text) in the driver's memory: for few texts. ``score`` never makes one."""
    rows = train.select(F.lit(0).alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(False).alias("held_out"))
    n = blocks(rows)
    grams = stored(gram_table(block_grams(dealt(rows, n)), n))
    table = grams.select("key", "n").orderBy("key").toArrow()
    return Model(table.column("key").to_numpy(), table.column("n").to_numpy(), learned_weights(grams))


def token_counts(train: DataFrame) -> DataFrame:
    """(token, c) over all rows of ``train``; the end is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

        seen: Counter = Counter()
        for batch in slices(batches, 0):
            for text in utf8(batch.column(0)):
                seen.update((text or b"").lower().split())
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield out()
                    seen = Counter()
        yield out()

    return train.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities."""
    spark = docs.sparkSession
    small_batches(spark)
    short_shuffles(spark)
    check = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), (check % HELD_OUT == 0).alias("held_out"))
    train = rows.where("NOT held_out")
    counts = stored(token_counts(train))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = {bytes(r.token): r.c for r in counts.where(F.col("c") * FREQUENT >= total).collect()}
    n = blocks(rows)
    rows = dealt(rows, n)
    folders = [copy_folder(spark) for _ in range(2)]
    found = stored(block_grams(rows), folders[0])
    grams = stored(gram_table(found, n), folders[1])
    weights = learned_weights(grams)
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
    names = ["key", "doc_id", "held_out", "n_tokens", "known", "part"]
    kind = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))
    schema = pa.schema([*zip(names, kinds), ("score", pa.float64()), ("rest", kind)])

    def run(block: tuple, table: pa.Table, needed: pa.Table) -> pa.Table:
        logs = {t: math.log10(c + 0.1) for t, c in common.items()}
        keys = needed.column("key").to_numpy()
        order = np.argsort(keys)
        keys, rows_ = keys[order], rows_of(needed.column("look"), LOOK)
        key, out, open_, at = (block[0].as_py() or 0) << 36, [], [], []
        ids, column, held = table.column("doc_id").to_pylist(), table.column("text"), table.column("held_out").to_pylist()
        longest = keys[keys >> TAG == LONGEST] & ((1 << TAG) - 1)
        grams = Table(longest, lambda wanted: rows_[order[np.searchsorted(keys, wanted)]], weights)
        del keys, order, rows_

        def flush() -> None:
            """Score the pieces that wait."""
            scores = log10_scores(*[np.concatenate(part) for part in zip(*at)], grams)
            for columns, rest in open_:
                own, scores = scores[: len(rest)], scores[len(rest) :]
                out.append(pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.float64()), rest], schema=schema))
            at.clear(), open_.clear()

        for place in pieces(text_sizes(column)):
            lines, to, tokens, times = [], [0], [], []
            texts = utf8(column[place])
            at.append(places(texts, grams))
            for i, text in zip(range(place.start, place.stop), texts):
                words = Counter((text or b"").lower().split())
                words[b""] += 1
                known, part = 0, 0.0
                for t, c in words.items():
                    if t in logs:
                        known, part = known + c, part + c * logs[t]
                    else:
                        tokens.append(t)
                        times.append(c)
                to.append(len(tokens))
                lines.append((key + i, ids[i], held[i], words.total(), known, part))
            rest = pa.StructArray.from_arrays([pa.array(tokens, pa.binary()), pa.array(times, pa.int64())], ["token", "n"])
            open_.append(([pa.array([x[j] for x in lines], t) for j, t in enumerate(kinds)], pa.ListArray.from_arrays(pa.array(to, pa.int32()), rest)))
            if sum(len(a) for a, _ in at) >= WAITING:
                flush()
        if at:
            flush()
        return pa.Table.from_batches(out, schema)

    needed = found.select("block", "key").join(grams.select("key", "look"), "key").select("block", "key", "look")
    marks = stored(rows.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(run, ROW))
    dropped(spark, *folders)
    rare = marks.select("key", F.explode("rest").alias("r")).select("key", "r.token", "r.n").join(counts, "token", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("key").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(c + F.lit(0.1))).alias("logs"))
    base = math.log10(total + 0.1 * (distinct + 1))
    out = marks.drop("rest").join(rare, "key", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * base).alias("base_score"), "score")
