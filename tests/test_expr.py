from pyspark.sql import functions as F

from panelwise.functions import expr as x
from panelwise.functions.hashing import hash_uniform, with_mix_uniform
from panelwise.operators import columns, exclusion
from panelwise.sources.load import load_csv


def values(df, c):
    return [r[c] for r in df.collect()]


def test_null_test_gives_null(spark):
    df = spark.createDataFrame([(30.0, 1.0), (130.0, 2.0), (None, 3.0)], "age double, t double")
    out = df.select(
        x.cross_invalidate("t", "age", 122).alias("t"), x.if_else_null(F.col("age") > 122, 1, 0).alias("old")
    )
    assert [tuple(r) for r in out.collect()] == [(1.0, 0), (None, 1), (None, None)]


def test_sentinels_and_ranges(spark):
    df = spark.createDataFrame([(98, 5.0), (1, 6.7), (None, None), (99, 251.1), (2, 300.0)], "e int, b double")
    out = df.select(x.sentinel_to_null("e", [98, 99]).alias("e"), x.range_to_null("b", 6.7, 251.1).alias("b"))
    assert [tuple(r) for r in out.collect()] == [(None, None), (1, 6.7), (None, None), (None, 251.1), (2, None)]


def test_under_treatment(spark):
    rows = [  # flag, start, end, dx -> wanted
        (None, None, None, 10.0, None), (1, None, None, 10.0, None), (None, 5.0, 20.0, 10.0, 1),
        (None, 15.0, 20.0, 10.0, 0), (None, 5.0, None, 10.0, None), (None, 15.0, None, 10.0, 0),
        (0, 5.0, 20.0, 10.0, 0), (1, 5.0, None, 10.0, 1),
    ]
    df = spark.createDataFrame(rows, "f int, s double, e double, dx double, want int")
    for r in df.withColumn("got", x.in_interval_flag("f", "s", "e", "dx")).collect():
        assert r["got"] == r["want"], r


def test_round_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,), (0.5,)], "v double")
    assert values(df.select(x.round_even("v").alias("v")), "v") == [2.0, 4.0, -2.0, 0.0]


def test_fills_and_levels(spark):
    df = spark.createDataFrame([(None, 3, 8), (1, 1, 7), (None, 1, 2)], "f int, wave int, t int")
    out = df.select(
        x.default_fill("f", 0, F.col("wave") == 3).alias("f"), x.merge_levels("t", {8: 7}).alias("t"),
        x.threshold_flag("t", 7).alias("ge"), x.threshold_flag("t", 7, strict=True).alias("gt"),
    )
    assert [tuple(r) for r in out.collect()] == [(0, 7, 1, 1), (1, 7, 1, 0), (None, 2, 0, 0)]


def test_ordinals_and_relocation(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "a int, b int, c int, d int, e int")
    assert columns.keep_columns(df, (1, 2), 5).columns == ["a", "b", "e"]
    assert columns.drop_columns(df, 2, (4, 5)).columns == ["a", "c"]
    assert columns.relocate(df, "a", after="c").columns == ["b", "c", "a", "d", "e"]
    assert columns.relocate(df, "e", before="a").columns == ["e", "a", "b", "c", "d"]


def test_remap_keys(spark):
    df = spark.createDataFrame([("p", 484), ("q", 484), ("p", None), ("p", 7)], "source string, id long")
    out = exclusion.remap_keys(df, "id", {484: 14}, where=F.col("source") == "p", null_to=415)
    assert values(out, "id") == [14, 484, 415, 7]


def test_any_answer_by_cohort(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", None, 1), ("b", 1, None), ("b", None, 1)], "source string, x int, y int")
    kept = exclusion.any_answer(df, ["x"], {"b": ["y"]})
    assert [tuple(r) for r in kept.collect()] == [("a", 1, None), ("b", None, 1)]


def test_hash_uniform_does_not_depend_on_partitions(spark):
    df = spark.range(5000)
    a = df.repartition(3).withColumn("u", hash_uniform(1, "id"))
    b = df.repartition(11).withColumn("u", hash_uniform(1, "id"))
    assert a.exceptAll(b).count() == 0
    m, v = a.agg(F.avg("u"), F.var_pop("u")).first()
    assert abs(m - 0.5) < 0.02 and abs(v - 1 / 12) < 0.01


def test_mix_uniform_is_even_and_uncorrelated(spark):
    df = spark.range(200).crossJoin(spark.range(200).withColumnRenamed("id", "j"))
    u = with_mix_uniform(df, "u", 5, "id", "j")
    assert u.columns == ["id", "j", "u"]
    cells = u.groupBy(F.floor(F.col("u") * 16).alias("b")).count().collect()
    assert len(cells) == 16 and all(abs(r["count"] - 2500) < 250 for r in cells)
    v = with_mix_uniform(df.withColumn("j", F.col("j") + 1), "v", 5, "id", "j").withColumn("j", F.col("j") - 1)
    assert abs(u.join(v, ["id", "j"]).agg(F.corr("u", "v")).first()[0]) < 0.02


def test_typed_csv(spark, tmp_path):
    f = tmp_path / "study.csv"
    f.write_text("participant_id,source,wave,bmi,fa\n1,a,2,21.5,oops\n2,,1.0,NaN,40\nx,b,1.5,,7\n")
    t = load_csv(spark, str(f))
    assert dict(t.dtypes) == {"participant_id": "bigint", "source": "string", "wave": "int", "bmi": "double", "fa": "double"}
    assert [tuple(r) for r in t.collect()] == [(1, "a", 2, 21.5, None), (2, None, 1, None, 40.0), (None, "b", None, None, 7.0)]
