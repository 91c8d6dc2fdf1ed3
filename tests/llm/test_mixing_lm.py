"""Scores against a plain bit by bit model and plain unigram counts; held-out gain."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
from fixtures import DOCS, awkward

from panelwise.llm import mixing_lm as lm


def plain_base(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = {}
    for i, t in rows:
        for w in [] if held(i) else words(t):
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(words(t)), sum(w in c for w in words(t)), n, sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for i, t in rows]


def plain_score(model, text):
    """Bit by bit; weights change after each whole chunk."""
    weights, cost, pad = model.weights.copy(), 0.0, max(lm.ORDERS)
    data = b"\0" * pad + (text or "").encode().lower() + lm.END
    m = (1 << 64) - 1
    for start in range(pad, len(data), lm.CHUNK):
        grad, n = np.zeros_like(weights), np.zeros(len(weights))
        stop = min(start + lm.CHUNK, len(data))
        for at in range(start, stop):
            for k in range(8):
                node = 1 << k | data[at] >> (8 - k)
                bit, x = data[at] >> (7 - k) & 1, []
                for j, order in enumerate(lm.ORDERS):
                    h = 0
                    for back in range(1, order + 1):
                        h = (h + data[at - back] + 1) * 0x9E3779B97F4A7C15 & m
                    slot = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & m) >> (64 - lm.SLOT_BITS) ^ node
                    ones, seen = int(model.ones[j, slot]), int(model.all[j, slot])
                    x.append(max(-lm.MOST, min(lm.MOST, math.log((ones + 0.2) / (seen - ones + 0.2)))))
                gate = k * lm.SEEN + min(int(math.log2(seen + 1)) // 2, lm.SEEN - 1)
                total = float(weights[gate] @ x)
                cost += math.log1p(math.exp(-total if bit else total))
                grad[gate] += (bit - 1 / (1 + math.exp(-total))) * np.array(x)
                n[gate] += 1
        if stop - start == lm.CHUNK:
            weights += lm.RATE * grad / np.maximum(n, 1)[:, None]
    return -cost / math.log(10)


def test_base_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 3)
    rows = [r for r in awkward() if r[0] != 8] + [(i, "Rare words " * (i % 3) + f"w{i}", "en", "a", 1) for i in range(100, 140)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score / 10, 6)) for r in lm.score(docs).collect()), key=str)
    assert got == sorted(((*r[:5], round(r[5] / 10, 6)) for r in plain_base([r[:2] for r in rows])), key=str)
    assert lm.score(docs.limit(0)).collect() == []


def test_scores_are_those_of_the_plain_model_and_better_than_unigrams(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(300)]
    model = lm.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    tables = model.prepare()
    long = " ".join(rng.choice(words) for _ in range(900))
    for text in ("", None, "a", texts[0], long, "é\0 \U0001f600"):
        assert math.isclose(model.log10(text.encode() if text else None, tables), plain_score(model, text), rel_tol=1e-4)
    bits = lambda t: -model.log10(t.encode(), tables) / math.log10(2) / len(t)
    assert bits(long) < 2.2 < 6 < bits("QZX#" * 300)


def test_weights_adapt_after_each_byte_of_short_texts_too(spark, monkeypatch):
    """Texts of a few bytes up: neither fixed weights nor weights that wait for a chunk; texts that share steps do not share weights."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc ") for _ in range(n)) for n in (0, 1, 2, 9, 63, 64, 65, 180, 2300)]
    model = lm.fit(spark.createDataFrame([(t,) for t in texts * 3], "text string"))
    table = lm.Table(np.unique(np.concatenate([lm.packed([t.encode()])[0] for t in texts])), model.prepare(), model.weights)
    got = lm.log10_scores(*lm.places([t.encode() for t in texts], table), table)
    want = {}
    for chunk in (1, 2048, 10**9):
        with monkeypatch.context() as m:
            m.setattr(lm, "CHUNK", chunk)
            want[chunk] = [plain_score(model, t) for t in texts]
    assert np.allclose(got, want[1], rtol=1e-4)
    for other in (want[2048], want[10**9]):
        assert not any(math.isclose(a, b, rel_tol=1e-3) for a, b in zip(got[4:], other[4:]))


def test_no_two_contexts_share_counts(spark, monkeypatch):
    """Far more contexts than any small table of slots holds apart, in several blocks, texts over a chunk too, against counts by whole context."""
    monkeypatch.setattr(lm, "PIECE", 3000)
    monkeypatch.setattr(lm, "GATHERED", 4000)
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2500 if i % 9 == 0 else 300)), "en", "a", 1) for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    seen, pad = {}, max(lm.ORDERS)
    for i, t, *_ in rows:
        data = b"\0" * pad + t.encode() + lm.END
        for at in range(pad, len(data)) if zlib.crc32(str(i).encode()) % 10 else ():
            for order in lm.ORDERS:
                for k in range(9):
                    path = (data[at - order : at], 1 << k | data[at] >> (8 - k))
                    seen[path] = seen.get(path, 0) + 1
    weights = lm.fit(docs.where("crc32(cast(doc_id as string)) % 10 <> 0")).weights
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    for i, t, *_ in rows[::7]:
        data, own, cost = b"\0" * pad + t.encode() + lm.END, weights.copy(), 0.0
        for start in range(pad, len(data), lm.CHUNK):
            stop = min(start + lm.CHUNK, len(data))
            grad, n = np.zeros_like(own), np.zeros(len(own))
            for at in range(start, stop):
                for k in range(8):
                    paths = [(data[at - o : at], 1 << k | data[at] >> (8 - k)) for o in lm.ORDERS]
                    same = [seen.get((c, 1 << (k + 1) | data[at] >> (7 - k)), 0) for c, _ in paths]
                    all_ = [seen.get(p, 0) for p in paths]
                    x = np.clip([math.log((s + 0.2) / (a - s + 0.2)) for s, a in zip(same, all_)], -lm.MOST, lm.MOST)
                    gate = k * lm.SEEN + min(int(math.log2(all_[-1] + 1)) // 2, lm.SEEN - 1)
                    total = float(own[gate] @ x)
                    cost += math.log1p(math.exp(-total))
                    grad[gate] += x / (1 + math.exp(total))
                    n[gate] += 1
            if stop - start == lm.CHUNK:
                own += lm.RATE * grad / np.maximum(n, 1)[:, None]
        assert math.isclose(got[i], -cost / math.log(10), rel_tol=1e-4)


def test_a_block_reads_its_texts_a_piece_at_a_time(spark, monkeypatch):
    """No call gets more texts than a piece has, so that a block's texts are not held a second time."""
    rows = [(i, f"word{i} " * 4500, "en", "a", 1) for i in range(60)]
    most = lm.PIECE + 40_000

    def few(column, utf8=lm.utf8):
        texts = utf8(column)
        assert sum(len(t or b"") + 1 for t in texts) < most
        return texts

    monkeypatch.setattr(lm, "utf8", few)
    monkeypatch.setattr(lm, "slices", lambda batches, place: (b.slice(i, 1) for b in batches for i in range(b.num_rows)))
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    monkeypatch.setattr(lm, "blocks", lambda rows: 1)
    assert lm.score(docs).count() == 60


def test_copies_and_shuffles_go_as_soon_as_they_are_used(spark):
    """While the last join runs, only the token counts and the marks are left of the copies, and no shuffle of an earlier execution."""
    from pathlib import Path

    from panelwise.session import ensure_checkpoint_dir

    rows = [(i, f"word{i % 7} and more " * 20, "en", "a", 1) for i in range(40)]
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("llm-*"))
    scores = lm.score(spark.createDataFrame(rows, DOCS))
    left = set(folder.glob("llm-*")) - before
    assert {tuple(spark.read.parquet(str(f)).columns) for f in left} == {("token", "c"), tuple(c.split()[0] for c in lm.ROW.replace("array<struct<token:binary,n:long>>", "x").split(", "))}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    assert scores.count() == 40 and sorted(r.doc_id for r in scores.collect()) == list(range(40))
