import math
import random

import pytest
from pyspark.sql import functions as F

from panelwise.operators import sampling, validate


def scored(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = round(rng.random(), 2)
        rows.append((i, 1 + i % 2, int(rng.random() < p), p))
    return spark.createDataFrame(rows, "row_id long, imp int, y int, p double")


def table(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "imp int, p double, n1 long, n0 long")


def test_rate_without_denominator_is_null(spark):
    c = validate.confusion_matrix(table(spark, [(0.1, 2, 3), (0.2, 0, 1)]), ["imp"])
    r = validate.classification_metrics(c, ["imp"]).first()
    assert r["precision"] is None and r["sensitivity"] == 0.0 and r["specificity"] == 1.0
    assert r["npv"] == pytest.approx(4 / 6)
    s = validate.metric_summary(validate.long_metrics(validate.classification_metrics(c, ["imp"]), [], ["precision"]))
    assert s.first()["n"] == 0


def test_c_statistic_against_all_pairs(spark):
    df = scored(spark)
    rows = df.where("imp = 1").collect()
    pairs = [(a["p"], b["p"]) for a in rows if a["y"] for b in rows if not b["y"]]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    s = validate.score_table(df, ["imp"])
    for cuts in ([], [0.2, 0.5, 0.8]):
        got = validate.c_statistic(s, ["imp"], cuts).where("imp = 1").first()["c_statistic"]
        assert got == pytest.approx(want)


def test_all_ties_give_half(spark):
    assert validate.c_statistic(table(spark, [(0.4, 5, 9)]), ["imp"], []).first()["c_statistic"] == 0.5


def test_slope_of_a_recalibrated_score_is_one(spark):
    s = validate.score_table(scored(spark, 2000), ["imp"])
    fit = validate.calibration_slope(s, ["imp"])
    z = F.log(validate._clamped() / (1 - validate._clamped()))
    again = s.join(fit, "imp").select("imp", (1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * z)))).alias("p"), "n1", "n0")
    for r in validate.calibration_slope(again, ["imp"]).collect():
        assert r["slope"] == pytest.approx(1, abs=1e-6) and r["intercept"] == pytest.approx(0, abs=1e-6)


def test_r2_definition(spark):
    s = table(spark, [(0.2, 1, 3), (0.8, 3, 1)])
    d = -2 * (math.log(0.2) + 3 * math.log(0.8) + 3 * math.log(0.8) + math.log(0.2))
    d0 = -2 * 8 * math.log(0.5)
    want = (1 - math.exp((d - d0) / 8)) / (1 - math.exp(-d0 / 8))
    assert validate.nagelkerke_r2(s, ["imp"]).first()["r2"] == pytest.approx(want)


def test_exact_weights_sum_to_n_on_any_partitioning(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    tables = []
    try:
        for partitions in ("2", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            w = sampling.bootstrap_weights(scored(spark), ["imp"], "row_id", 5, 1, "exact")
            sums = w.groupBy("imp", "replicate").agg(F.sum("weight").alias("n")).collect()
            assert len(sums) == 10 and all(r["n"] == 200 for r in sums)
            tables.append(sorted(map(tuple, w.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tables[0] == tables[1]


def test_poisson_weights_have_mean_and_variance_one(spark):
    n, b = 400, 200
    w = sampling.bootstrap_weights(scored(spark, n), ["imp"], "row_id", b, 1, "poisson")
    s1, s2 = w.agg(F.sum("weight"), F.sum(F.col("weight") ** 2)).first()
    assert s1 / (n * b) == pytest.approx(1, abs=0.02) and s2 / (n * b) - (s1 / (n * b)) ** 2 == pytest.approx(1, abs=0.03)


def test_poisson_and_exact_bootstrap_agree_on_spread(spark):
    df = scored(spark, 1000)
    sd = {}
    for method in ("exact", "poisson"):
        out = sampling.bootstrap_statistics(
            df, ["imp"], "row_id", ["y"], {"rate": F.sum(F.col("weight") * F.col("y")) / F.sum("weight")}, 200, 1, method
        )
        sd[method] = out.groupBy("imp").agg(F.stddev("rate").alias("s")).agg(F.avg("s")).first()[0]
    assert sd["poisson"] == pytest.approx(sd["exact"], rel=0.2)
    assert sd["exact"] == pytest.approx(math.sqrt(0.25 / 500), rel=0.2)


def test_roc_ends_and_average(spark):
    roc = validate.roc_curve(validate.score_table(scored(spark), ["imp"]), ["imp"], [])
    ends = roc.groupBy("imp").agg(F.min("tpr"), F.max("tpr"), F.min("fpr"), F.max("fpr")).collect()
    assert all(tuple(r)[1:] == (0.0, 1.0, 0.0, 1.0) for r in ends)
    avg = [r["mean_tpr"] for r in validate.roc_average(roc, ["imp"]).orderBy("fpr").collect()]
    assert len(avg) == 21 and avg == sorted(avg) and avg[-1] == 1.0


def test_split_share_and_shared_mask(spark):
    df = scored(spark, 2000)
    s = sampling.train_test_split(df, "row_id", (7, 3), 100)
    assert s.agg(F.avg(F.col("is_train").cast("int"))).first()[0] == pytest.approx(0.7, abs=0.04)
    typo = sampling.train_test_split(df, "row_id", (0.7, 3), 100)
    assert typo.agg(F.avg(F.col("is_train").cast("int"))).first()[0] == pytest.approx(0.7 / 3.7, abs=0.03)
