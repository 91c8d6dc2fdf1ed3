"""Shapes of executed plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle_check import TESTDATA
from panelwise.operators import sampling, validate, visits
from panelwise.plans import views

SF = str(TESTDATA / "sf0.001")


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    plan = executed(entry.queries()["cohort_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(c_mktsegment), Not(EqualTo(c_mktsegment,MACHINERY))" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan
    assert "o_totalprice" not in plan


def test_first_row_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("source"), (F.col("id") % 7).alias("participant_id"), F.col("id").alias("wave"))
    plan = executed(visits.first_per_key(df, ["source", "participant_id"], ["wave"]))
    assert re.search(r"row_number\(\), 1, Partial", plan)


def test_both_ends_come_from_one_aggregate(spark):
    df = spark.range(100).select(
        (F.col("id") % 5).alias("source"), (F.col("id") % 7).alias("participant_id"), F.col("id").alias("wave"),
        (F.col("id") / 8).alias("time_diagnosis"), (F.col("id") % 2).alias("y"))
    plan = executed(visits.baseline_endpoint(df, "y", ["wave"])).split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "partial_max_by" in plan


@pytest.mark.parametrize("name", [
    "carry_from_baseline", "harmonise_cohorts", "baseline_endpoint_rate", "c_statistic", "roc_curve",
    "bootstrap_classification", "bootstrap_weights_poisson", "attrition_report", "trajectories",
])
def test_no_cartesian_product(spark, name):
    plan = executed(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_poisson_draws_are_not_shuffled_before_they_are_summed(spark):
    s = views.scored(spark, SF)
    drawn = sampling.bootstrap_rows(s, ["imp"], "row_id", ["p", "y"], 10, 1, "poisson")
    plan = validate.score_table(drawn, ["imp", "replicate"], F.col("weight"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(imp") < plan.index("partial_sum") < plan.index("explode(")
    assert "Join" not in plan
