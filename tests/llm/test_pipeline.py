"""The pipeline's stages on a small folder of tables: columns, decisions, totals."""

from __future__ import annotations

import random

import corpus_pipeline
import pyarrow as pa
from fixtures import DOCS, awkward
from test_jaccard import plain_classes

from panelwise.llm.common import TEXTS


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(90)) for _ in range(60)]
    # Ids apart from those of the awkward rows: classes are counted by their least id.
    rows = [(1000 + i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)] + [(1100 + i, prose[i], "en", "s0", 1) for i in range(20)]
    rows += [(200, "short", "en", "s0", 5), (201, prose[0] + " mail me@x.org", "en", "s1", 1)] + awkward()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, 0) for i in range(50)] + [(200, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        kept.append(docs)
    quality, dedup, private, mixed, packed = kept
    assert all(k.columns == [c.split()[0] for c in DOCS.split(", ")] for k in kept[:-1])
    assert 200 not in {r.doc_id for r in quality.collect()}
    classes = len(set(plain_classes([r.text for r in quality.collect()])))
    assert dedup.count() == classes == private.count() and not {r.doc_id for r in dedup.collect()} & set(range(1100, 1120))
    assert mixed.count() > 0
    total = sum(len(r.text.split()) for r in mixed.collect())
    assert packed.agg({"n_words": "sum"}).first()[0] == total
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, packed.collect()))


def test_stages_send_whole_texts_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    docs, rows = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS), spark.range(0, 3000, 1, 1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    try:
        for before, after in ((10000, TEXTS), (100, 100)):
            spark.conf.set(name, before)
            corpus_pipeline.private(spark, docs, "")
            assert rows.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] == after
    finally:
        spark.conf.set(name, old)
