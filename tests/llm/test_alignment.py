"""Alignment against a plain walk over bytes, encodings by the tokenizer files' own library, awkward rows, corpus-wide counts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from fixtures import DOCS, LONG, awkward
from tokenizers import Tokenizer

from panelwise.llm import alignment
from panelwise.llm.queries import tokenizer_alignment

ODD = ["a  b", " a", "a\tb\r\n\n c", "\u2581x", "<s> hi </s> <|endoftext|>", "\x00a", "\uff46\uff55", "\U0001f600 e\u0301 it's 12,345.67",
       "\u65e5\u672c\u8a9e\u306e\u6587", " ", "\n", "\u00a0", "don't I'LL we've", "\u0645\u0631\u062d\u0628\u0627"]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair.read()


@pytest.fixture(scope="module")
def byte_bpe():
    made = Tokenizer.from_file(alignment.BYTE_BPE)
    made.encode_special_tokens = True
    return made


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def walk(text, pair, byte_bpe):
    """(a spans, b spans, groups, links) by comparing all spans."""
    if not text:
        return [], [], [], []
    letter = alignment._byte_letters()
    ids = byte_bpe.encode(" " + text, add_special_tokens=False).ids
    a = spans([(i, bytes(letter[c] for c in byte_bpe.id_to_token(i))) for i in ids])
    sp = pair.b
    b = spans([(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("\u2581", " ").encode())
               for i, p in ((i, sp.id_to_piece(i)) for i in sp.encode(text))])
    whole = (" " + text).encode()
    if not a or not b or a[-1][2] != len(whole) or b[-1][2] != len(whole) or pair.b.decode([i for i, _, _ in b]) != text:
        return [], [], [], []
    common = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups, low = [], 0
    for high in common:
        groups.append(([i for i, s, e in a if low <= s and e <= high], [i for i, s, e in b if low <= s and e <= high]))
        low = high
    return a, b, groups, [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]


def texts(rng, n):
    words = ["".join(rng.choice("abcdefghijklmnop \u00e9\u00df") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    return ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_gallop_equals_binary_search():
    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (1, 1), (5, 2000), (1000, 3000), (3000, 10)):
        driver, other = (np.sort(rng.choice(10_000, k, replace=False)) for k in (n, m))
        for stride in (1, 7, 256):
            assert (alignment.gallop(driver, other, stride) == np.searchsorted(other, driver)).all()


def test_blocks_equal_a_plain_walk(pair, byte_bpe):
    batch = [None, "", *texts(random.Random(1), 60), None]
    made = alignment.align(batch, pair)
    listings = made.listings(pair)
    links = list(zip(made.a[made.link_a].tolist(), made.b[made.link_b].tolist()))
    at = 0
    for k, text in enumerate(batch):
        a, b, groups, linked = walk(text, pair, byte_bpe)
        assert listings[k].decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert (made.a_to[k] - (made.a_to[k - 1] if k else 0), made.b_to[k] - (made.b_to[k - 1] if k else 0)) == (len(a), len(b))
        assert sorted(links[at:at + len(linked)]) == sorted(linked)
        at += len(linked)
    assert at == len(links)


def test_fast_encoder_equals_the_files_own_library(pair, byte_bpe):
    for text in [*texts(random.Random(2), 200), "x" * 5000, " " * 999, LONG[:20000], "\n \n\t" * 300]:
        assert pair.encode(text)[0].tolist() in ([], byte_bpe.encode(" " + text, add_special_tokens=False).ids)


def test_alignments_are_cut_by_row(spark, pair, byte_bpe):
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts(random.Random(4), 20))] + awkward()
    got = alignment.alignments(spark.createDataFrame(rows, DOCS), pair).where("id >= 0 AND id < 20").collect()
    known = {i: t for i, t, *_ in rows[:20]}
    seen = 0
    for r in got:
        if r.id in known and r.a:
            a, b, groups, _ = walk(known[r.id], pair, byte_bpe)
            if [x for x, _, _ in a] == r.a:
                made = [(r.a[x:y], r.b[u:v]) for x, y, u, v in zip([0, *r.a_cuts], r.a_cuts, [0, *r.b_cuts], r.b_cuts)]
                assert made == groups
                seen += 1
    assert seen >= 15


def test_query_equals_brute_force(spark, pair, byte_bpe, tmp_path):
    rows = [r for r in awkward() if not r[1] or len(r[1]) < 1000]
    rows += [(100 + i, t, "en", "a", 1) for i, t in enumerate(texts(random.Random(6), 60))]
    spark.createDataFrame([(*r, 7, 8) for r in rows], DOCS + ", block int, codes int").write.parquet(f"{tmp_path}/documents.parquet")
    walks = [walk(r[1], pair, byte_bpe) for r in rows]
    counts = Counter(link for *_, links in walks for link in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    expected = []
    for r, (a, b, groups, links) in zip(rows, walks):
        listing = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        expected.append((r[0], len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links),
                         sum(counts[x] for x in links), hashlib.sha256(listing.encode()).hexdigest() if a else ""))
    got = [tuple(r) for r in tokenizer_alignment(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    small = alignment.profiles(spark.read.parquet(f"{tmp_path}/documents.parquet").repartition(5), pair, block_bytes=300)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(expected, key=str)


def test_empty_table_and_long_texts(spark, pair):
    docs = spark.createDataFrame([(1, LONG, "de", "a", 1), (2, "x" * 100_000, "de", "a", 1)], DOCS)
    assert alignment.profiles(docs.limit(0), pair).collect() == []
    got = {r.id: r for r in alignment.profiles(docs, pair).collect()}
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups > 0 for r in got.values())
