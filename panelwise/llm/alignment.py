"""Alignment of two tokenizers' tokens of the same text, and how often their ids meet.

Both tokenizers cut the same bytes, so a token is known by the byte it ends before. Galloping intersection:
the shorter list of ends drives; exponential steps in the longer one find a window, binary search in it the
rank of each end. An end with an equal in the other list closes a group of tokens on both sides.
The ranks also give all overlaps: the token of the shorter list between two ends overlaps the other list's tokens
from the first one's rank (after an equal end) to the second one's rank.

Links (pairs of overlapping tokens) are counted for the whole corpus by pairs of ids. Texts are taken in
blocks of bounded size. A block's links become codes into the block's own dictionary of id pairs, so that the
shuffles hold a row for each pair and block, not for each link, and a document meets the corpus-wide
counts of its pairs when its block does. No block grows with the corpus, and a pair that
every document holds is one row a block.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import stored
from panelwise.llm.periodic import slices

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Ends taken together in one gallop.
STRIDE = 256
#: The splitting pattern of byte-level tokenizers (a fixed value of that public format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Pair:
    """The two tokenizers, as the bytes of their files: read once by the driver, loaded once by each Python worker."""

    byte_bpe: bytes
    piece_bpe: bytes

    @classmethod
    def read(cls, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> Pair:
        with open(byte_bpe, "rb") as a, open(piece_bpe, "rb") as b:
            return cls(a.read(), b.read())

    def __getstate__(self) -> dict:
        return {"byte_bpe": self.byte_bpe, "piece_bpe": self.piece_bpe}

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        """Ids by token bytes. Merges must be ranked as their results' ids are, as in all files of this format's origin."""
        model = json.loads(self.byte_bpe)["model"]
        letter = _byte_letters()
        ids = model["vocab"]
        made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("the merges of the byte-level vocabulary are not in order of ids")
        return {bytes(letter[c] for c in token): i for token, i in ids.items() if all(c in letter for c in token)}

    @cached_property
    def a(self) -> Any:
        import tiktoken

        return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def b(self) -> Any:
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.piece_bpe)

    @cached_property
    def a_lengths(self) -> np.ndarray:
        lengths = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, i in self.ranks.items():
            lengths[i] = len(token)
        return lengths

    @cached_property
    def b_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]

    @cached_property
    def b_lengths(self) -> np.ndarray:
        return np.array([len(x) for x in self.b_bytes], np.int64)

    @cached_property
    def decimal(self) -> list[bytes]:
        """Every id in decimal, followed by nothing, ',', '|' or ';': id + 0, 1, 2 or 3 times ``width``."""
        return [b"%d%s" % (i, end) for end in (b"", b",", b"|", b";") for i in range(self.width)]

    @cached_property
    def width(self) -> int:
        return max(len(self.a_lengths), len(self.b_lengths))

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space + text by both; none if the text is empty or either one's tokens do not spell it."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not text:
            return none
        whole = b" " + text.encode()
        b = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return none
        a = self.a.encode_ordinary(" " + text)
        if self.a.decode_bytes(a) != whole:
            return none
        return np.array(a, np.int64), np.array(b, np.int64)


def gallop(driver: np.ndarray, other: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """For each value of ``driver`` the number of smaller values in ``other``; both rise strictly."""
    ranks = np.empty(len(driver), np.int64)
    at, n = 0, len(other)
    for first in range(0, len(driver), stride):
        part = driver[first : first + stride]
        beyond, step = at, len(part)
        while beyond < n and other[beyond] < part[-1]:
            beyond += step
            step *= 2
        found = at + np.searchsorted(other[at : min(beyond + 1, n)], part)
        ranks[first : first + stride] = found
        at = int(found[-1])
    return ranks


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b) of every common end, (place in a, place in b) of every overlapping pair of tokens.

    Both lists of ends start from byte 0 and have the same last end.
    """
    if len(ends_a) > len(ends_b):
        common_b, common_a, link_b, link_a = overlaps(ends_b, ends_a)
        return common_a, common_b, link_a, link_b
    rank = gallop(ends_a, ends_b)
    equal = ends_b[rank] == ends_a if len(rank) else np.empty(0, bool)
    first = np.zeros(len(rank), np.int64)
    first[1:] = (rank + equal)[:-1]
    times = rank - first + 1
    link_a = np.repeat(np.arange(len(rank)), times)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    return np.flatnonzero(equal), rank[equal], link_a, link_b


@dataclass
class Block:
    """The aligned tokens of several texts. ``*_to``: for each text the tokens or groups up to its end, all texts before included."""

    a: np.ndarray
    b: np.ndarray
    a_to: np.ndarray
    b_to: np.ndarray
    groups_to: np.ndarray
    common_a: np.ndarray
    common_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    def listings(self, pair: Pair) -> list[bytes]:
        """For each text its groups as ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b = len(self.a), len(self.b)
        group_a, group_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        group_a[self.common_a[:-1] + 1] = 1
        group_b[self.common_b[:-1] + 1] = 1
        group_a, group_b = np.cumsum(group_a), np.cumsum(group_b)
        before_b = np.concatenate([[0], self.common_b + 1])
        place_a = np.arange(n_a) + before_b[group_a] if n_a else np.empty(0, np.int64)
        place_b = np.arange(n_b) + self.common_a[group_b] + 1 if n_b else np.empty(0, np.int64)
        written = np.empty(n_a + n_b, np.int64)
        ends = np.ones(n_a, np.int64)
        ends[self.common_a] = 2
        written[place_a] = self.a + ends * pair.width
        ends = np.ones(n_b, np.int64)
        ends[self.common_b] = 3
        last = self.b_to[np.diff(self.b_to, prepend=0) > 0] - 1
        ends[last] = 0
        written[place_b] = self.b + ends * pair.width
        parts = list(map(pair.decimal.__getitem__, written.tolist()))
        to = (self.a_to + self.b_to).tolist()
        return [b"".join(parts[x:y]) for x, y in zip([0, *to], to)]


def align(texts: list[str | None], pair: Pair) -> Block:
    """Tokens, groups and links of several texts, laid end to end: every text's end is a common end."""
    encoded = [pair.encode(t) for t in texts]
    a = np.concatenate([np.empty(0, np.int64), *(x for x, _ in encoded)])
    b = np.concatenate([np.empty(0, np.int64), *(y for _, y in encoded)])
    a_to = np.cumsum([len(x) for x, _ in encoded], dtype=np.int64)
    b_to = np.cumsum([len(y) for _, y in encoded], dtype=np.int64)
    found = overlaps(np.cumsum(pair.a_lengths[a]), np.cumsum(pair.b_lengths[b]))
    return Block(a, b, a_to, b_to, np.searchsorted(found[0], a_to), *found)


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def alignments(docs: DataFrame, pair: Pair | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b, a_cuts, b_cuts) of every row: token ids of space + text, and for each group the tokens up to its end.

    NULL and empty texts, and texts that either tokenizer's tokens do not spell, have no tokens and no groups.
    Repeated rows give repeated rows, NULL ids stay; other columns are not read, whatever their names.
    """
    pair = pair or Pair.read()
    names = ["id", "a", "b", "a_cuts", "b_cuts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            made = align(batch.column(1).to_pylist(), pair)
            parts = []
            for values, to, less in ((made.a, made.a_to, None), (made.b, made.b_to, None),
                                     (made.common_a + 1, made.groups_to, made.a_to), (made.common_b + 1, made.groups_to, made.b_to)):
                sizes = np.diff(to, prepend=0)
                if less is not None:
                    values = values - np.repeat(np.concatenate([[0], less[:-1]]), sizes)
                parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]), pa.int32()), pa.array(values, pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts], names)

    return _ids(docs, id_col, text_col).mapInArrow(run, "id long, " + ", ".join(f"{n} array<int>" for n in names[1:]))


def _lists(values: np.ndarray, to: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]), pa.int32()), pa.array(values, kind))


BLOCKS = ("id long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, "
          "times array<int>, pairs array<long>, met array<long>")


def blocks(docs: DataFrame, pair: Pair, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each text with its counts and its links by codes (how many times each), and a row for each block,
    without counts, with the block's pairs of ids (a * 2^32 + b; the code is the place) and their links in the block.
    """
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(slices(batches, 1, block_bytes)):
            n = batch.num_rows
            made = align(batch.column(1).to_pylist(), pair)
            shas = [hashlib.sha256(x).hexdigest() if x else "" for x in made.listings(pair)]
            pairs, code = np.unique(made.a[made.link_a] << 32 | made.b[made.link_b], return_inverse=True)
            text = np.searchsorted(made.a_to, made.link_a, "right")
            width = max(len(pairs), 1)
            each, times = np.unique(text * width + code, return_counts=True)
            met = np.bincount(code, minlength=len(pairs)) if len(pairs) else np.empty(0, np.int64)
            to = np.searchsorted(each, (np.arange(n) + 1) * width)
            sizes = lambda x: pa.array(np.diff(x, prepend=0), pa.int64())
            links = pa.array(np.bincount(text, minlength=n), pa.int64())
            at = pa.array([place + number] * n, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), at, sizes(made.a_to), sizes(made.b_to), sizes(made.groups_to), links, pa.array(shas, pa.string()),
                _lists(each % width, to, pa.int32()), _lists(times, to, pa.int32()),
                pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names)
            none = [pa.nulls(1, t) for t in [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int32())] * 2]
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, pa.int64()), at[:1], *none, _lists(pairs, np.array([len(pairs)]), pa.int64()),
                _lists(met, np.array([len(met)]), pa.int64())], names)

    return docs.mapInArrow(run, BLOCKS)


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, met, best): links of every pair of ids in all blocks, and whether no other pair of the same b is met more often."""
    each = made.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "met")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.met").alias("met"))
    counts = stored(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    most = counts.groupBy(F.col("b").alias("_b")).agg(F.max("met").alias("most"))
    return counts.join(most, counts.b == most._b).select("pair", "met", (F.col("met") == F.col("most")).alias("best"))


def profiles(docs: DataFrame, pair: Pair | None = None, id_col: str = "doc_id", text_col: str = "text",
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A pair of ids counts as often as a link of the corpus (repeated rows included) holds it. ``n_best``: links whose pair has the
    highest count of its b, ties included; ``count_sum``: the counts, over all links. NULL and empty texts, and texts that
    either tokenizer's tokens do not spell, have zeros and an empty digest; NULL ids stay; other columns are
    not read, whatever their names. Tokens run once, over texts where they are read; what is
    shuffled are the links of a text by codes and a row for each pair of a block.
    """
    made = stored(blocks(_ids(docs, id_col, text_col), pair or Pair.read(), block_bytes))
    texts = made.where("pairs IS NULL").drop("pairs", "met")
    own = made.where("pairs IS NOT NULL").select(F.col("block").alias("of"), F.posexplode("pairs").alias("code", "pair"))
    known = own.join(pair_counts(made), "pair").select("of", "code", "met", "best")
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        width = right.num_rows
        met, best = np.zeros(width, np.int64), np.zeros(width, np.int64)
        code = right.column("code").to_numpy()
        met[code] = right.column("met").to_numpy()
        best[code] = right.column("best").to_numpy().astype(np.int64)
        codes, times = left.column("codes").combine_chunks(), left.column("times").combine_chunks()
        sizes = np.array(codes.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        at, k = codes.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(left.num_rows), sizes)
        sums = []
        for values in (best, met):
            total = np.zeros(left.num_rows, np.int64)
            np.add.at(total, row, k * values[at] if len(at) else k)
            sums.append(pa.array(total, pa.int64()))
        found = {c: left.column(c) for c in names if c in left.column_names} | {"n_best": sums[0], "count_sum": sums[1]}
        return pa.table({n: found[n] for n in names})

    return texts.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(meet, schema)
