"""Panel, score and training views over the given tables.

The tables hold no missing values, so sentinel codes are written in by key; the
recode operators then turn them into NULLs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.functions.expr import range_to_null, sentinel_to_null, years_from_days
from panelwise.functions.hashing import hash_uniform
from panelwise.operators.grouping import ordered_index

KEY = ["source", "participant_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (source, participant_id, wave): an order is a visit, a segment a cohort."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    visits = ordered_index(
        orders.withColumn("day", F.to_date("o_orderdate")),
        ["o_custkey"], ["o_orderdate", "o_orderkey"],
        F.year("o_orderdate") * 4 + F.quarter("o_orderdate"), "visit",
        group_min={"first_day": F.col("day")},
    )
    visits = visits.join(customers, visits.o_custkey == customers.c_custkey)
    key, person = F.col("o_orderkey"), F.col("o_custkey")

    def coded(every: int, sentinel: int, value):
        return F.when(key % every == 0, F.lit(sentinel)).otherwise(value)

    priority = F.substring("o_orderpriority", 1, 1)
    return visits.select(
        F.col("c_mktsegment").alias("source"),
        person.alias("participant_id"),
        F.col("visit").cast("int").alias("wave"),
        key.alias("row_id"),
        coded(11, -1, F.datediff("day", "first_day")).cast("int").alias("time_dx_days"),
        F.when(priority == "4", 98).otherwise(F.expr("try_cast(substring(o_orderpriority, 1, 1) AS INT)"))
        .alias("education"),
        coded(10, 99, key % 3).cast("int").alias("smoking"),
        coded(13, 99, 1 + key % 4).cast("int").alias("alcoholuse"),
        (F.col("o_totalprice") / 2000).alias("bmi"),
        coded(17, 999, 20 + person % 60).cast("int").alias("age_questionnaire"),
        coded(19, 999, F.col("o_totalprice") / 5000).cast("double").alias("fa"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1)
        .otherwise(99).alias("under_treatment"),
        (1 + key % 4).cast("int").alias("stage"),
        (1 + person % 8).cast("int").alias("tumortype"),
        (key % 400).cast("int").alias("time_dx_start_treatment_days"),
        (key % 400 + person % 700).cast("int").alias("time_dx_end_treatment_days"),
    )


def clean_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel after its recodes: sentinels, ranges and implausible ages are NULL."""
    p = panel(spark, sf_dir)
    age = F.col("age_questionnaire")
    known_age = F.when(age <= 122, F.lit(True))
    p = p.withColumns({
        "time_dx_days": F.when(known_age, range_to_null("time_dx_days", low=0)),
        "education": sentinel_to_null("education", [98, 99]),
        "smoking": sentinel_to_null("smoking", [98, 99]),
        "alcoholuse": sentinel_to_null("alcoholuse", [99]),
        "bmi": range_to_null("bmi", 6.7, 251.1),
        "age_questionnaire": range_to_null("age_questionnaire", high=122),
        "fa": range_to_null("fa", high=100),
        "under_treatment": sentinel_to_null("under_treatment", [99]),
    })
    return p.withColumn("time_diagnosis", years_from_days("time_dx_days"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic risk score with an outcome, in ten runs; rounding makes ties."""
    o = table(spark, sf_dir, "orders")
    y = (F.col("o_orderstatus") == "F").cast("int")
    p = F.round(F.lit(0.1) + F.lit(0.3) * y + F.lit(0.5) * hash_uniform(1, "o_orderkey"), 3)
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_orderkey") % 10 + 1).cast("int").alias("imp"),
        y.alias("y"),
        p.alias("p"),
    )


def train_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per participant, the first visit with a valid score, and a learnable outcome."""
    from panelwise.operators.visits import first_per_key

    p = panel(spark, sf_dir).where(F.col("fa") <= 100)
    first = first_per_key(p, KEY, ["wave"])
    risk = (
        F.lit(0.6) * F.col("fa") / 100
        + F.lit(0.2) * (F.col("stage") == 1).cast("int")
        + F.lit(0.2) * hash_uniform(2, "row_id")
    )
    return first.select(
        "source", "participant_id", "row_id", "fa", "bmi",
        F.least(F.col("age_questionnaire"), F.lit(122)).cast("double").alias("age_questionnaire"),
        "education", "stage", "tumortype",
        (risk >= 0.55).cast("int").alias("y"),
    )


def train_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table with values taken away by hash, to be imputed."""
    t = train_table(spark, sf_dir)
    return t.withColumns({
        "bmi": F.when(hash_uniform(3, "row_id") >= 0.1, F.col("bmi")),
        "fa": F.when(hash_uniform(4, "row_id") >= 0.1, F.col("fa")),
        "education": F.when(hash_uniform(5, "row_id") >= 0.1, F.col("education")),
    })


def study_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given orders in the shape of the study's raw table, gaps and odd codes included."""
    orders = table(spark, sf_dir, "orders")
    v = ordered_index(
        orders.withColumn("day", F.to_date("o_orderdate")),
        ["o_custkey"], ["o_orderdate", "o_orderkey"],
        F.year("o_orderdate") * 4 + F.quarter("o_orderdate"), "visit",
        group_min={"first_day": F.col("day")},
    )
    v = v.select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("visit").cast("int").alias("v"),
        F.col("o_totalprice").alias("price"),
        F.expr("cast(datediff(day, first_day) * 2 div 5 AS INT)").alias("days"),
    )
    cohort = """CASE c % 6 WHEN 0 THEN 'PLCRC' WHEN 1 THEN 'procore' WHEN 2 THEN 'lymphoma'
                WHEN 3 THEN 'rogy' WHEN 4 THEN 'blazib' ELSE 'prozib' END"""
    fa = "CASE WHEN k % 37 = 0 THEN NULL ELSE price / 5000 END"
    return v.selectExpr(
        f"CASE WHEN c % 6 = 1 AND k % 23 = 0 THEN NULL ELSE {cohort} END AS source",
        "CASE WHEN c = 415 THEN NULL ELSE c END AS participant_id",
        """CASE WHEN c % 6 = 4 THEN CASE v WHEN 1 THEN 0 WHEN 2 THEN 6 WHEN 3 THEN 12 WHEN 4 THEN 24
           ELSE 24 + v END ELSE v END AS wave""",
        "k AS row_id",
        "CAST(CASE WHEN k % 3 = 0 THEN NULL WHEN k % 41 = 0 THEN -3 ELSE days END AS DOUBLE) AS time_dx_days",
        "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 31 = 0 THEN -1D ELSE days / 365D END AS time_diagnosis",
        "CAST(CASE WHEN k % 9 = 0 THEN NULL ELSE k % 400 END AS DOUBLE) AS time_dx_start_treatment_days",
        "CAST(CASE WHEN k % 9 = 0 OR k % 4 = 1 THEN NULL ELSE k % 400 + c % 700 END AS DOUBLE) AS time_dx_end_treatment_days",
        "CAST(CASE WHEN k % 8 = 0 THEN NULL WHEN k % 6 = 0 THEN 98 ELSE k % 5 END AS INT) AS education",
        "CAST(CASE WHEN k % 7 = 0 THEN NULL ELSE k % 2 END AS INT) AS partner",
        "CAST(CASE WHEN k % 10 = 0 THEN 99 ELSE k % 3 END AS INT) AS smoking",
        "CAST(CASE WHEN k % 13 = 0 THEN 99 ELSE 1 + k % 3 END AS INT) AS alcoholuse",
        "price / 2000 AS bmi",
        "CAST(CASE WHEN k % 4 = 0 THEN NULL ELSE 20 + c % 60 END AS DOUBLE) AS age_diagnosis",
        """CAST(CASE WHEN k % 17 = 0 THEN 999 WHEN c % 6 IN (3, 4) AND k % 6 = 0 THEN NULL
           ELSE 20 + c % 60 + v END AS DOUBLE) AS age_questionnaire""",
        "CAST(CASE WHEN k % 3 = 1 THEN NULL ELSE k % 2 END AS INT) AS under_treatment",
        "CAST(CASE WHEN c % 2 = 0 THEN NULL ELSE 1 + k % 4 END AS INT) AS stage_tnm",
        "CAST(CASE WHEN c % 2 = 0 THEN 1 + k % 4 ELSE NULL END AS INT) AS stage_annarbor",
        "CAST(1 + c % 8 AS INT) AS tumortype",
        "CAST(k % 2 AS INT) AS radiotherapy",
        "CAST(1 + c % 2 AS INT) AS sex",
        "CAST(CASE WHEN k % 11 = 0 THEN NULL ELSE k % 2 END AS INT) AS surgery",
        "CAST(CASE WHEN k % 12 = 0 THEN NULL ELSE c % 2 END AS INT) AS systemic",
        f"{fa} AS fa",
        "CASE WHEN k % 19 = 0 THEN 999D ELSE price / 6000 END AS sf",
        "CASE WHEN k % 29 = 0 THEN 999D ELSE price / 7000 END AS fi",
        *[f"CASE WHEN k % 37 = 0 THEN NULL ELSE k % 4 END AS qlqc30_{i}" for i in (10, 12, 18)],
        *[f"{fa} AS {s}" for s in ("ql", "pf", "rf", "ef", "cf", "nv", "pa", "dy", "sl", "ap", "co", "di")],
    )
