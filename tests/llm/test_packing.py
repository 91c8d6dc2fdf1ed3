"""Best-fit packing: against a plain search over all bins, and whole."""

from __future__ import annotations

import random
from collections import Counter

from fixtures import DOCS, awkward

from panelwise.llm import packing


def plain(rows, capacity, per_source):
    """The tightest compatible bin by looking at all bins; of equals the one that got its residual first."""
    bins, out, clock = [], [], 0
    for n, source, cluster in rows:
        clock += 1
        fits = [b for b in bins if b["left"] >= n and cluster not in b["clusters"] and (source is None or b["sources"][source] < per_source)]
        b = min(fits, key=lambda b: (b["left"], b["since"]), default=None)
        if b is None:
            b = {"left": capacity, "clusters": set(), "sources": Counter(), "at": len(bins)}
            bins.append(b)
        b["left"] -= n
        b["since"] = clock
        b["clusters"].add(cluster)
        b["sources"][source] += 1
        out.append(b["at"])
    return out


def test_tightest_compatible_bin():
    rng = random.Random(5)
    for _ in range(30):
        rows = [(rng.randint(1, 60), rng.choice(["hot", "hot", "a", None]), rng.randint(0, 40)) for _ in range(150)]
        rows.sort(key=lambda r: -r[0])
        assert packing.best_fit(rows, 64, 3) == plain(rows, 64, 3)


def test_every_word_is_packed_once(spark):
    docs = spark.createDataFrame(awkward(), DOCS)
    got = packing.sequences(docs, capacity=1000, per_source=2, shard_words=15000).collect()
    want = Counter()
    for r in awkward():
        for n, text in packing.cut_text(r[1].encode() if r[1] else None, 1000):
            want[r[0], n, text.decode()] += 1
    assert Counter((r.doc_id, r.n_words, r.text) for r in got) == want
    size = Counter()
    for r in got:
        size[r.bin] += r.n_words
    assert max(size.values()) <= 1000 and len({(r.bin, r.slot) for r in got}) == len(got)
    assert packing.placements(docs.limit(0)).collect() == []
