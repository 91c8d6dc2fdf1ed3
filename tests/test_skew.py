"""A third of all rows under one key: results equal those of the plain window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwise.operators import grouping, visits

KEY = ["source", "participant_id"]


@pytest.fixture(scope="module")
def hot(spark):
    i = F.col("id")
    person = F.when(i % 3 == 0, F.lit(0)).otherwise(i % 500 + 1)
    df = spark.range(6000).select(
        F.when(person == 0, "a").otherwise(F.concat(F.lit("s"), person % 3)).alias("source"),
        person.alias("participant_id"), i.alias("row_id"),
        F.when(i % 7 != 0, (i * 7919 % 6007) / 1000.0).alias("time_diagnosis"),
        F.when(i % 5 != 0, i % 4).alias("x"), (i % 2).alias("s"),
    )
    w = Window.partitionBy(*KEY).orderBy("row_id")
    return df.withColumn("wave", F.row_number().over(w)).cache()


def test_positions(hot):
    got = grouping.ordered_index(hot, KEY, ["row_id"], F.floor(F.col("row_id") / 700), "i")
    assert got.where("i <> wave").count() == 0 and got.count() == 6000


def test_carry(hot):
    w = Window.partitionBy(*KEY)
    donor = F.max(F.when(F.col("wave") == 2, F.col("x"))).over(w)
    want = hot.withColumn("x", F.when(F.col("x").isNull() & (F.col("wave") != 2), donor).otherwise(F.col("x")))
    assert visits.carry_from_visit(hot, ["x"], 2).exceptAll(want).count() == 0


def test_trajectories(hot, monkeypatch):
    monkeypatch.setattr(visits, "value_cuts", lambda d, c: [0.5, 2.0, 3.7])
    w = Window.partitionBy(*KEY).orderBy("time_diagnosis", "wave")
    want = hot.where("time_diagnosis IS NOT NULL").select(
        *KEY, "wave", "time_diagnosis", "s", F.row_number().over(w).cast("long").alias("seq"), F.lag("s").over(w).alias("previous")
    )
    got = visits.trajectories(hot, "s")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_dense_index(hot):
    d = grouping.hash_index(hot, ["source"], "row_id", "i", "n")
    r = d.groupBy("source").agg(F.min("i"), F.max("i"), F.count_distinct("i"), F.max("n"), F.count(F.lit(1))).collect()
    assert all(x[1] == 1 and x[2] == x[3] == x[4] == x[5] for x in r)
