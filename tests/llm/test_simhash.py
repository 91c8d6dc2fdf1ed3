"""SimHash classes against brute force: fingerprints one by one, links over all pairs."""

from __future__ import annotations

import random
import re

import xxhash
from fixtures import DOCS, awkward
from pyspark.sql import functions as F

from panelwise.llm import jaccard, simhash


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(marks):
    """Roots by brute force over all pairs of different fingerprints."""
    root = {m: m for m in marks}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    ordered = sorted(root)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {m: find(m) for m in ordered}


def plain_components(rows):
    marks = [plain_fingerprint(t) for _, t in rows]
    roots = plain_classes(set(marks))
    least = {}
    for (i, _), m in zip(rows, marks):
        if i is not None:
            least[roots[m]] = min(i, least.get(roots[m], i))
    return sorted(((i, f"{m:016x}", least.get(roots[m])) for (i, _), m in zip(rows, marks)), key=str)


def found(docs, **more):
    rows = simhash.classes(docs, **more).collect()
    return sorted(((r.id, f"{r.fp & (1 << 64) - 1:016x}", r.component) for r in rows), key=str)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == plain_components(rows)


def test_awkward_rows(spark):
    docs = spark.createDataFrame(awkward(), DOCS).withColumns({"fp": F.lit(1), "id": F.lit("x"), "content": F.lit(None)})
    rows = [(r[0], r[1]) for r in awkward()]
    assert found(docs) == plain_components(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # two classes are without words or a NULL id: one row of each class stays
    roots = plain_classes({plain_fingerprint(t) for _, t in rows})
    assert kept.count() == len(set(roots.values()))
    assert found(docs.limit(0)) == [] and simhash.keep_one(docs.limit(0)).count() == 0


def test_near_families_lose_no_link(spark):
    """Families around a centre, chains, and lone points; cells of 4 rows at most are paired."""
    rng = random.Random(3)
    flip = lambda m, n: m ^ sum(1 << b for b in rng.sample(range(64), n))
    points = [rng.getrandbits(64) for _ in range(60)]
    centre = rng.getrandbits(64)
    points += [flip(centre, rng.randint(1, 6)) for _ in range(150)]
    for _ in range(40):
        points.append(flip(points[-1], rng.randint(3, 5)))
    points = sorted(set(points))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    expected = plain_classes(set(points))
    for cap in (4, 128):
        links = simhash.links(df, cell_rows=cap)
        for r in links.collect():
            assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 or cap == 4
        got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.connected(links).collect()}
        together = {}
        for p in points:
            together.setdefault(got.get(p, p), set()).add(p)
        plain = {}
        for p, r in expected.items():
            plain.setdefault(r, set()).add(p)
        assert sorted(map(sorted, together.values())) == sorted(map(sorted, plain.values()))


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(5)
    rows = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long")
    df = df.select("a", "b", F.bit_count(simhash.unary_popcounts(F.col("a")).bitwiseXOR(simhash.unary_popcounts(F.col("b")))).alias("d"))
    for r in df.collect():
        counts = lambda x: [(x >> 2 * s & 3).bit_count() for s in range(32)]
        assert r.d == sum(abs(x - y) for x, y in zip(counts(r.a), counts(r.b))) <= (r.a ^ r.b).bit_count()


def test_no_table_is_broadcast_by_a_guess_at_its_size(spark, monkeypatch):
    """Rows that an explode makes are not in the guess: each stage's plan, before it is run, has no broadcast."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    plans = []

    def stored(df, *args, kept=simhash.stored):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return kept(df, *args)

    monkeypatch.setattr(simhash, "stored", stored)
    monkeypatch.setattr(jaccard, "stored", stored)
    rows = [(i, f"one two three four five six w{i % 40} seven eight", "en", "a", 1) for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for found in (simhash.classes(docs), jaccard.keep_one(docs)):
        plans.append(found._jdf.queryExecution().sparkPlan().toString())
    assert sum("Join" in p for p in plans) > 8 and not any("Broadcast" in p for p in plans)
    assert before == {k: spark.conf.get(k, None) for k in before}
