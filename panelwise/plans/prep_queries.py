"""Registered queries: loads, recodes, exclusions, carries, windows, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.functions import expr as x
from panelwise.operators import columns as cols
from panelwise.operators import encode, exclusion, profile, visits
from panelwise.operators.grouping import attach_group
from panelwise.plans import study
from panelwise.plans.views import KEY, clean_panel, panel, scored, study_panel, table
from panelwise.session import cut_lineage
from panelwise.sources.load import load_parquet

ID = ["source", "participant_id", "wave", "row_id"]
SOCIAL = ["education", "smoking", "alcoholuse"]
FOLLOW_UP = (4, 6)
FIRST_VISIT = (-0.25, 0.25)
FIXED_BASELINE = {"BUILDING": 1}
FIXED_ENDPOINT = {"BUILDING": 8}


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def typed_load(spark: SparkSession, d: str) -> DataFrame:
    types = {
        "o_orderkey": "bigint", "o_custkey": "int", "o_orderstatus": "string",
        "o_totalprice": "double", "o_orderpriority": "double",
    }
    t = load_parquet(spark, f"{d}/orders.parquet", types)
    return t.select("o_orderkey", "o_custkey", "o_orderstatus", _r("o_totalprice", 4), "o_orderpriority")


def mutate_chain(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    p = p.withColumn("time_dx_days", x.range_to_null("time_dx_days", low=0))
    p = p.withColumn("time_diagnosis", x.years_from_days("time_dx_days"))
    p = p.withColumn("age_now", F.col("age_questionnaire") + F.col("time_diagnosis"))
    return p.select(*ID, "time_dx_days", _r("time_diagnosis"), _r("age_now"))


def recode_columns(spark: SparkSession, d: str) -> DataFrame:
    p = cols.recode(panel(spark, d), SOCIAL, lambda c: x.sentinel_to_null(c, [98, 99]))
    return p.select(*ID, *SOCIAL)


def project_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns 1-4 and 6-8 of the panel, without the seventh of what is left."""
    p = cols.keep_columns(panel(spark, d), (1, 4), (6, 8))
    return cols.drop_columns(p, 7)


def relocate_column(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).select(*ID, "stage", "tumortype")
    moved = cols.relocate(p, "stage", after="tumortype")
    order = F.lit(",".join(moved.columns))
    return moved.withColumn("column_order", order)


def conditional_update(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    p = cols.update_where(p, (F.col("source") == "BUILDING") & (F.col("smoking") == 99), {"smoking": 0})
    return cols.update_where(p, F.col("wave") == 1, {"under_treatment": F.lit(1)}).select(
        *ID, "smoking", "under_treatment"
    )


def cohort_filter(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).where(F.col("source") != "MACHINERY").select(*ID, "stage")


def any_not_null(spark: SparkSession, d: str) -> DataFrame:
    p = clean_panel(spark, d)
    return exclusion.any_answer(p, ["education", "smoking"], {"BUILDING": ["fa", "bmi"]}).select(
        *ID, "education", "smoking", _r("fa"), _r("bmi")
    )


def followup_window(spark: SparkSession, d: str) -> DataFrame:
    return visits.followup_window(clean_panel(spark, d), *FOLLOW_UP).select(*ID, _r("time_diagnosis"))


def baseline_window(spark: SparkSession, d: str) -> DataFrame:
    return visits.baseline_window(clean_panel(spark, d), *FIRST_VISIT).select(*ID, _r("time_diagnosis"))


def complete_cases(spark: SparkSession, d: str) -> DataFrame:
    p = exclusion.complete_cases(clean_panel(spark, d), ["fa", "under_treatment", "time_diagnosis"])
    return p.select(*ID, _r("fa"), "under_treatment", _r("time_diagnosis"))


def exclude_category(spark: SparkSession, d: str) -> DataFrame:
    p = clean_panel(spark, d).withColumn("stage", F.when(F.col("row_id") % 7 != 0, F.col("stage")))
    return exclusion.exclude_category(p, "stage", 4).select(*ID, "stage")


def attrition_report(spark: SparkSession, d: str) -> DataFrame:
    p = attach_group(clean_panel(spark, d), KEY, {
        "_span": F.max(x.round_even("time_diagnosis", 1)) - F.min(x.round_even("time_diagnosis", 1)),
        "_first": F.min(x.round_even("time_diagnosis", 2)),
    })
    return exclusion.attrition_report(p, {
        "any_answer": x.any_not_null(SOCIAL),
        "followed": F.col("_span").between(*FOLLOW_UP),
        "early": F.col("_first").between(*FIRST_VISIT),
        "outcome": F.col("fa").isNotNull(),
        "not_stage_4": F.col("stage") != 4,
    })


def sentinel_to_null(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    return p.select(
        *ID, x.sentinel_to_null("education", [98, 99]).alias("education"),
        x.sentinel_to_null("smoking", [98, 99]).alias("smoking"),
        x.sentinel_to_null("alcoholuse", [99]).alias("alcoholuse"),
    )


def range_to_null(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    bounds = {"bmi": (6.7, 251.1), "time_dx_days": (0, None), "fa": (None, 100), "age_questionnaire": (None, 122)}
    p = p.withColumns({c: x.range_to_null(c, *b) for c, b in bounds.items()})
    return p.select(*ID, _r("bmi"), "time_dx_days", _r("fa"), "age_questionnaire")


def cross_invalidate(spark: SparkSession, d: str) -> DataFrame:
    age = F.when(F.col("row_id") % 8 != 0, F.col("age_questionnaire"))
    p = panel(spark, d).withColumn("age_questionnaire", age)
    return p.select(
        *ID, x.cross_invalidate("time_dx_days", "age_questionnaire", 122).alias("time_dx_days"),
        x.cross_invalidate("age_questionnaire", "age_questionnaire", 122).alias("age_questionnaire"),
    )


def default_fill(spark: SparkSession, d: str) -> DataFrame:
    p = clean_panel(spark, d)
    return p.select(
        *ID, x.default_fill("smoking", 0).alias("smoking"),
        x.default_fill("under_treatment", 0, F.col("wave") == 3).alias("under_treatment"),
    )


def coalesce_columns(spark: SparkSession, d: str) -> DataFrame:
    return clean_panel(spark, d).select(*ID, F.coalesce("education", "smoking").alias("merged"))


def derive_units(spark: SparkSession, d: str) -> DataFrame:
    p = clean_panel(spark, d)
    days = F.when(F.col("row_id") % 4 != 0, F.col("time_dx_days"))
    return p.select(
        *ID, F.round(x.years_from_days("time_dx_days"), 6).alias("years"),
        F.round(x.years_from_months("wave"), 6).alias("visit_years"),
        F.round(F.coalesce(days, x.days_from_years("time_diagnosis")), 4).alias("days_filled"),
    )


def if_else_null(spark: SparkSession, d: str) -> DataFrame:
    p = clean_panel(spark, d)
    return p.select(*ID, x.if_else_null(F.col("time_dx_days") > 700, "late", "early").alias("phase"))


def interval_flag_fill(spark: SparkSession, d: str) -> DataFrame:
    p = clean_panel(spark, d)
    flag = x.interval_flag_fill(
        "under_treatment", "time_dx_start_treatment_days", "time_dx_end_treatment_days", "time_dx_days",
        F.col("wave") == 1,
    )
    return p.select(*ID, flag.alias("under_treatment"))


def under_treatment_flag(spark: SparkSession, d: str) -> DataFrame:
    p = clean_panel(spark, d).withColumns({
        "s": F.when(F.col("row_id") % 3 != 0, F.col("time_dx_start_treatment_days")),
        "e": F.when(F.col("row_id") % 5 != 0, F.col("time_dx_end_treatment_days")),
    })
    return p.select(*ID, x.in_interval_flag("under_treatment", "s", "e", "time_dx_days").alias("under_treatment"))


def round_derive(spark: SparkSession, d: str) -> DataFrame:
    p = clean_panel(spark, d)
    age, t = F.col("age_questionnaire"), F.col("time_diagnosis")
    return p.select(
        *ID, x.round_even(age + t).alias("age_by_time"), x.round_even(age + F.col("wave") / 12).alias("age_by_wave"),
        x.round_even(F.col("wave") / 2).alias("half_wave"), x.round_even(t, 2).alias("time_2"),
    )


def negative_fix(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select(*ID, F.round(x.negative_fix("time_dx_days", "wave"), 6).alias("time_fixed"))


def outcome_flag(spark: SparkSession, d: str) -> DataFrame:
    p = clean_panel(spark, d)
    return p.select(
        *ID, x.threshold_flag("fa", 40).alias("fa_cat"), x.threshold_flag("fa", 39, strict=True).alias("fa_cat_strict")
    )


def cohort_binarise(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("alcoholuse")
    flag = F.when(F.col("source") == "BUILDING", x.if_else_null(a == 1, 1, 0)).otherwise(x.if_else_null(a > 1, 1, 0))
    return clean_panel(spark, d).select(*ID, flag.alias("alcoholuse"))


def merge_levels(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select(*ID, x.merge_levels("tumortype", {8: 7}).alias("tumortype"))


def remap_keys(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).withColumn("participant_id", F.when(F.col("row_id") % 50 != 0, F.col("participant_id")))
    p = exclusion.remap_keys(
        p, "participant_id", study.REMAPPED_IDS, where=F.col("source") == "BUILDING", null_to=study.UNNAMED_ID
    )
    return p.select(*ID)


def factor_encode(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return encode.factor_encode(o, ["o_orderpriority", "o_orderstatus"]).select(
        "o_orderkey", "o_orderpriority_code", "o_orderstatus_code"
    )


def carry_from_baseline(spark: SparkSession, d: str) -> DataFrame:
    return visits.carry_from_visit(clean_panel(spark, d), SOCIAL, 1).select(*ID, *SOCIAL)


def carry_with_offset(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("wave")
    p = visits.carry(clean_panel(spark, d), [
        visits.Carry("time_diagnosis", 1, 1, w == 3), visits.Carry("time_diagnosis", 1, 2, w == 4),
    ])
    return p.select(*ID, _r("time_diagnosis"))


def carry_chained(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("wave")
    p = visits.carry(clean_panel(spark, d), [visits.Carry("time_diagnosis", 1, 1, w == 3)])
    p = visits.carry(p, [visits.Carry("time_diagnosis", 3, 1, w == 4)])
    return p.select(*ID, _r("time_diagnosis"))


def carry_any_wave(spark: SparkSession, d: str) -> DataFrame:
    p = visits.carry(clean_panel(spark, d), [visits.Carry("age_questionnaire", 2)])
    return p.select(*ID, "age_questionnaire")


def harmonise_cohorts(spark: SparkSession, d: str) -> DataFrame:
    p = study.harmonise_study(study.recode_study(study_panel(spark, d)))
    return p.select(
        *ID, _r("time_dx_days"), _r("time_diagnosis"), "time_dx_end_treatment_days", "age_diagnosis",
        "age_questionnaire", "under_treatment", "education", "partner", "smoking", "alcoholuse",
    )


def model_table(spark: SparkSession, d: str) -> DataFrame:
    t = study.prepare_study(study_panel(spark, d))
    return t.select(
        "source", "participant_id", "wave", "tumortype", "stage", "radiotherapy", "surgery", "systemic", "sex", _r("bmi"),
        *[_r(s) for s in study.SCALES], "age_diagnosis",
        _r("time_dx_days"), "time_dx_start_treatment_days", "under_treatment", "age_questionnaire",
        "education", "partner", "smoking", "alcoholuse", "fa_cat_end",
    )


def baseline_endpoint(spark: SparkSession, d: str) -> DataFrame:
    p = clean_panel(spark, d).withColumn("fa_cat", x.threshold_flag("fa", 40))
    return visits.baseline_endpoint(
        p, "fa_cat", ["row_id", "stage", "tumortype"],
        baseline_fixed=FIXED_BASELINE, endpoint_fixed=FIXED_ENDPOINT,
    )


def baseline_endpoint_rate(spark: SparkSession, d: str) -> DataFrame:
    """Outcome rate at the endpoint by cohort and baseline outcome, after carry and follow-up windows.

    The carried panel is read three times from here on, so it is written once.
    """
    p = visits.carry_from_visit(clean_panel(spark, d), SOCIAL, 1)
    p = cut_lineage(p.withColumn("fa_cat", x.threshold_flag("fa", 40)))
    p = visits.study_window(p, FOLLOW_UP, FIRST_VISIT)
    t = visits.baseline_endpoint(p, "fa_cat", SOCIAL).dropna(subset=["fa_cat_base", "fa_cat_end"])
    return t.groupBy("source", "fa_cat_base").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("fa_cat_end"), 6).alias("rate"),
        F.count("education").alias("known_education"),
    )


def dataset_overview(spark: SparkSession, d: str) -> DataFrame:
    return profile.dataset_overview(panel(spark, d))


NUMERIC = ["time_dx_days", "education", "smoking", "alcoholuse", "bmi", "age_questionnaire", "fa", "time_diagnosis"]


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_profile(clean_panel(spark, d), NUMERIC)


def level_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.level_counts(clean_panel(spark, d), "education")


def missing_report(spark: SparkSession, d: str) -> DataFrame:
    return profile.missing_report(clean_panel(spark, d), NUMERIC)


def outcome_by_cohort(spark: SparkSession, d: str) -> DataFrame:
    p = clean_panel(spark, d).withColumn("fa_cat", x.threshold_flag("fa", 40))
    return profile.outcome_by_group(p, "fa_cat", "source")


def apply_columns(spark: SparkSession, d: str) -> DataFrame:
    p = clean_panel(spark, d)
    return profile.apply_columns(p, NUMERIC, lambda c: F.round(F.avg(F.col(c).cast("double")), 6), "mean")


def histogram(spark: SparkSession, d: str) -> DataFrame:
    p = clean_panel(spark, d)
    long = profile.stack_columns(p, ["bmi", "fa", "time_diagnosis"], "metric", "value")
    return profile.histogram(long, "metric", "value")


def group_span(spark: SparkSession, d: str) -> DataFrame:
    p = visits.group_span(clean_panel(spark, d))
    return p.select(*ID, _r("time_elapsed"), "time_min", "time_max")


def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    p = clean_panel(spark, d).where(F.col("fa").isNotNull())
    return visits.first_per_key(p, KEY, ["wave"]).select(*ID, _r("fa"), "stage", "tumortype")


def baseline_row(spark: SparkSession, d: str) -> DataFrame:
    return visits.baseline_row(clean_panel(spark, d), FIXED_BASELINE).select(*ID, _r("time_diagnosis"), "stage")


def endpoint_row(spark: SparkSession, d: str) -> DataFrame:
    return visits.endpoint_row(clean_panel(spark, d), FIXED_ENDPOINT).select(*ID, _r("time_diagnosis"), "stage")


def trajectories(spark: SparkSession, d: str) -> DataFrame:
    p = clean_panel(spark, d).withColumn("fa_cat", x.threshold_flag("fa", 40))
    return visits.trajectories(p, "fa_cat").withColumn("time_diagnosis", F.round("time_diagnosis", 6))


def sorted_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select(*ID, "stage").orderBy("participant_id", "wave")


def union_cohorts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    done = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", F.lit("done").alias("part"))
    rest = o.where("o_orderstatus <> 'F'").select(F.lit("open").alias("part"), "o_custkey", "o_orderkey")
    return done.unionByName(rest)


def run_effects(spark: SparkSession, d: str) -> DataFrame:
    """Per run and feature, how much higher the score is among events: a small (imp, feature, coef) table."""
    s = scored(spark, d).join(table(spark, d, "orders"), F.col("row_id") == F.col("o_orderkey"))
    s = s.select("imp", "y", F.col("p").alias("score"), (F.col("o_totalprice") / 5000).alias("fa"),
                 (F.col("o_custkey") % 60).alias("age"), (F.col("o_orderkey") % 4).alias("stage"),
                 (F.col("o_orderkey") % 3).alias("smoking"))
    long = profile.stack_columns(s, ["score", "fa", "age", "stage", "smoking"], "feature", "v", ["imp", "y"])
    return long.groupBy("imp", "feature").agg(
        (F.avg(F.when(F.col("y") == 1, F.col("v"))) - F.avg(F.when(F.col("y") == 0, F.col("v")))).alias("coef")
    )


def coef_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = run_effects(spark, d).groupBy("feature").pivot("imp", list(range(1, 11))).agg(F.round(F.first("coef"), 6))
    return wide.select("feature", *[F.col(str(i)).alias(f"imp_{i}") for i in range(1, 11)])


def coef_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.summarise(run_effects(spark, d), "feature", "coef")


def top_features(spark: SparkSession, d: str) -> DataFrame:
    mean = run_effects(spark, d).groupBy("feature").agg(F.round(F.avg(F.abs("coef")), 6).alias("importance"))
    return mean.orderBy(F.desc("importance"), "feature").limit(3)


QUERIES = {
    f.__name__: f
    for f in (
        typed_load, mutate_chain, recode_columns, project_columns, relocate_column, conditional_update,
        cohort_filter, any_not_null, followup_window, baseline_window, complete_cases, exclude_category,
        attrition_report, sentinel_to_null, range_to_null, cross_invalidate, default_fill, coalesce_columns,
        derive_units, if_else_null, interval_flag_fill, under_treatment_flag, round_derive, negative_fix,
        outcome_flag, cohort_binarise, merge_levels, remap_keys, factor_encode, carry_from_baseline,
        carry_with_offset, carry_chained, carry_any_wave, harmonise_cohorts, model_table, baseline_endpoint,
        baseline_endpoint_rate, dataset_overview, column_profile, level_counts, missing_report,
        outcome_by_cohort, apply_columns, histogram, group_span, first_per_key, baseline_row, endpoint_row,
        trajectories, sorted_panel, union_cohorts, coef_wide, coef_summary, top_features,
    )
}
