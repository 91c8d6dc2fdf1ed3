"""Best-fit packing of documents into sequences, with conflicts.

Documents are counted in words. Longer ones than ``capacity`` are cut into pieces of that length
and a rest; full pieces fill a bin each. All other pieces are placed in falling order of length:
the bins of a shard are ordered by residual, each carries a bitmap of the sources that are used up
in it (``per_source`` pieces) and one of the duplicate clusters it holds. The search starts at
the smallest residual that fits and goes on to the successor until a bin is compatible: the tightest
compatible bin. Only if there is none, a new bin is opened.

Pieces are dealt to shards by hash, so a hot source or cluster is spread over all shards and its
pieces conflict only where they meet. Shards hold ``shard_words`` on average, so their number grows
with the input and a task's memory does not. A piece is placed exactly once.

Defined results: NULL and empty texts have no words and no piece; a NULL source conflicts
with nothing; NULL ids are packed; repeated rows are packed each for themselves (and kept apart, being
duplicates); other columns are not read; an empty table gives no bins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import stored, utf8

CAPACITY = 4096
PER_SOURCE = 8
SHARD_WORDS = 2_000_000
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
PIECE = "doc_id long, source string, cluster long, piece long, n_words long"
PLACED = "bin string, slot long, doc_id long, piece long, n_words long"


def cut_text(text: bytes | None, capacity: int) -> list[tuple[int, bytes]]:
    """(words, text) of each piece; a piece keeps the white space between its words."""
    text = text or b""
    spans = [m.span() for m in WORDS.finditer(text)]
    return [(len(part), text[part[0][0]:part[-1][1]]) for part in (spans[i:i + capacity] for i in range(0, len(spans), capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_text: bool = False) -> DataFrame:
    """(doc_id, source, cluster, piece, n_words[, text]): cluster is a hash of the document's lower-cased words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                cluster = xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split())) - (1 << 63)
                for k, (n, part) in enumerate(cut_text(text, capacity)):
                    for column, value in zip(out, (doc_id, source, cluster, k, n, part)):
                        column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(out, kinds)]
            names = ["doc_id", "source", "cluster", "piece", "n_words", "text"]
            keep = 6 if with_text else 5
            arrays[5] = arrays[5].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays[:keep], names[:keep])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, PIECE + (", text string" if with_text else ""))


def best_fit(rows: list[tuple], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[int]:
    """The bin of each row (words, source, cluster); rows come in falling order of words.

    ``filled`` has bit r set if a bin has residual r; ``at[r]`` lists these bins, oldest first.
    """
    code: dict = {}
    source_bit = [0 if s is None else 1 << code.setdefault(s, len(code)) for _, s, _ in rows]
    times: dict = {}
    for _, _, c in rows:
        times[c] = times.get(c, 0) + 1
    twins = {c: 1 << i for i, c in enumerate(c for c, n in times.items() if n > 1)}
    at: dict[int, list[int]] = {}
    filled = 0
    sources: list[int] = []
    clusters: list[int] = []
    used: list[dict] = []
    out = []
    for (n, source, cluster), s in zip(rows, source_bit):
        c = twins.get(cluster, 0)
        above, found = filled >> n << n, -1
        while above and found < 0:
            r = (above & -above).bit_length() - 1
            for place, b in enumerate(at[r]):
                if not (sources[b] & s or clusters[b] & c):
                    found = b
                    at[r].pop(place)
                    break
            else:
                above &= above - 1
        if found < 0:
            found, r = len(used), capacity
            sources.append(0)
            clusters.append(0)
            used.append({})
        elif not at[r]:
            filled ^= 1 << r
        clusters[found] |= c
        if s:
            used[found][source] = used[found].get(source, 0) + 1
            if used[found][source] >= per_source:
                sources[found] |= s
        left = r - n
        if left:
            at.setdefault(left, []).append(found)
            filled |= 1 << left
        out.append(found)
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(bin, slot, doc_id, piece, n_words, ...) of every piece of ``parts``, which has PIECE and maybe text."""
    total = parts.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    columns = ["doc_id", "piece", "n_words", *(["text"] if "text" in parts.columns else [])]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_words", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable")
        source = [None if pd.isna(s) else s for s in group["source"]]
        found = best_fit(list(zip(group["n_words"].tolist(), source, group["cluster"].tolist())), capacity, per_source)
        group = group.assign(bin=[f"{key[0]}-{b}" for b in found], number=found)
        group["slot"] = group.groupby("number").cumcount()
        return group[["bin", "slot", *columns]]

    shard = F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards))
    schema = PLACED + (", text string" if "text" in columns else "")
    return parts.withColumn("shard", shard).repartition(shards, "shard").groupBy("shard").applyInPandas(run, schema)


def placements(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """(bin, slot, doc_id, piece, n_words) of every piece of every document."""
    return pack(stored(pieces(docs, capacity)), capacity, **options)


def sequences(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """Placements with the pieces' texts."""
    return pack(stored(pieces(docs, capacity, with_text=True)), capacity, **options)
