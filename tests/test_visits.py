import pytest
from pyspark.sql import functions as F

from panelwise.operators import grouping, visits
from panelwise.operators.harmonise import Rule, harmonise
from panelwise.plans.study import COHORT_RULES, harmonise_study


def by_key(df, *cols):
    return {(r["source"], r["participant_id"], r["wave"]): tuple(r[c] for c in cols) for r in df.collect()}


def test_carry_takes_the_donor_of_the_same_person(spark):
    rows = [
        ("a", 1, 1, 5), ("a", 1, 2, None), ("a", 1, 3, 7), ("a", 2, 2, None), ("a", 3, 1, None), ("a", 3, 2, None),
        ("b", 1, 1, 9), ("b", 1, 2, None),
    ]
    df = spark.createDataFrame(rows, "source string, participant_id int, wave int, x int")
    got = by_key(visits.carry_from_visit(df, ["x"], 1), "x")
    assert got["a", 1, 2] == (5,) and got["a", 1, 3] == (7,) and got["b", 1, 2] == (9,)
    assert got["a", 2, 2] == (None,) and got["a", 3, 2] == (None,) and got["a", 3, 1] == (None,)


STUDY_COLUMNS = (
    "source string, participant_id long, wave int, time_dx_days double, time_diagnosis double,"
    "time_dx_start_treatment_days double, time_dx_end_treatment_days double, education int, partner int,"
    "smoking int, alcoholuse int, age_diagnosis double, age_questionnaire double, under_treatment int"
)


def visit(source, pid, wave, **given):
    names = [c.split()[0] for c in STUDY_COLUMNS.split(",")]
    return tuple({"source": source, "participant_id": pid, "wave": wave, **given}.get(n) for n in names)


def test_cohort_rules(spark):
    rows = [
        visit("blazib", 1, 0, time_dx_days=73.0, education=3, age_diagnosis=50.0),
        visit("blazib", 1, 6, age_diagnosis=50.0), visit("blazib", 1, 12, age_diagnosis=50.0), visit("blazib", 1, 24),
        visit("blazib", 2, 0, time_dx_days=-3.0), visit("blazib", 2, 6),
        visit("rogy", 1, 1, age_diagnosis=40.0), visit("rogy", 1, 2, time_diagnosis=0.9), visit("rogy", 1, 3),
        visit("rogy", 1, 5),
        visit("rogy", 2, 1, time_diagnosis=0.5, time_dx_start_treatment_days=1.0, time_dx_end_treatment_days=2.0),
        visit("rogy", 2, 2, partner=1),
        visit("procore", None, 1, time_dx_days=365.0, time_dx_end_treatment_days=10.0), visit("procore", None, 4),
        visit("procore", 484, 1, smoking=1), visit("lymphoma", 484, 2, age_diagnosis=33.0), visit("lymphoma", 484, 3),
        visit("prozib", 1, 2, time_dx_days=730.0, age_questionnaire=61.0), visit("prozib", 1, 3, partner=None),
        visit("PLCRC", 1, 1, alcoholuse=1, partner=1), visit("PLCRC", 1, 2),
    ]
    out = harmonise_study(spark.createDataFrame(rows, STUDY_COLUMNS))
    got = by_key(out, "time_diagnosis", "time_dx_days", "under_treatment", "age_questionnaire")
    year = pytest.approx
    assert got["blazib", 1, 6][0] == year(0.7) and got["blazib", 1, 12][0] == year(1.2)
    assert got["blazib", 1, 24][0] == year(2.2)  # from month 12, itself filled one statement earlier
    assert got["blazib", 1, 24][1] == year(2.2 * 365) and got["blazib", 1, 24][2] == 0
    assert got["blazib", 1, 6][3] == 50.0 and got["blazib", 1, 12][3] == 51.0
    assert got["blazib", 2, 0][0] == 0.0  # a negative time becomes the visit's
    assert got["blazib", 2, 6][0] == year(-3 / 365 + 0.5)
    assert got["rogy", 1, 1][0] == year(0.4) and got["rogy", 1, 1][3] == 40.0
    assert got["rogy", 1, 3][0] is None and got["rogy", 1, 5][0] is None  # donor was unknown when they were filled
    assert got["rogy", 2, 1][2] == 1 and got["rogy", 2, 2][0] == year(1.0)
    assert got["procore", 415, 4][0] == year(3.0)
    assert ("procore", 14, 1) in got and ("lymphoma", 484, 2) in got
    assert got["prozib", 1, 3][0] == year(3.0) and got["prozib", 1, 3][3] == 62.0 and got["prozib", 1, 3][2] == 0
    social = by_key(out, "education", "partner", "alcoholuse", "age_diagnosis", "time_dx_end_treatment_days")
    assert social["blazib", 1, 24][0] == 3
    assert social["PLCRC", 1, 2][:3] == (None, 1, None)  # alcohol use is not carried in this cohort
    assert social["lymphoma", 484, 3][3] == 33.0
    assert social["procore", 415, 4][4] == 10.0


def test_rules_of_a_block_do_not_see_each_others_donor_fills(spark):
    rows = [("s", 1, 1, 1.0), ("s", 1, 2, None), ("s", 1, 3, None)]
    df = spark.createDataFrame(rows, "source string, participant_id int, wave int, t double")
    two, three = dict(donor=1, offset=1, at=(2,)), dict(donor=2, offset=1, at=(3,))
    same = harmonise(df, [Rule("s", 1, ("t",), **two), Rule("s", 1, ("t",), **three)])
    later = harmonise(df, [Rule("s", 1, ("t",), **two), Rule("s", 2, ("t",), **three)])
    assert by_key(same, "t")["s", 1, 3] == (None,) and by_key(later, "t")["s", 1, 3] == (3.0,)


def test_rule_table_costs_one_aggregate_and_one_join(spark):
    df = spark.createDataFrame([visit("rogy", 1, 1)], STUDY_COLUMNS)
    plan = harmonise(df, COHORT_RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1


def test_windows_drop_untimed_and_short_groups(spark):
    rows = [
        ("a", 1, 1, 0.1), ("a", 1, 2, 2.2), ("a", 2, 1, None), ("a", 2, 2, None), ("a", 3, 1, 0.0),
        ("a", 4, 1, 1.0), ("a", 4, 2, 3.5),
    ]
    df = spark.createDataFrame(rows, "source string, participant_id int, wave int, time_diagnosis double")
    left = {r["participant_id"] for r in visits.followup_window(df, 2, 3).collect()}
    assert left == {1, 4}
    assert {r["participant_id"] for r in visits.baseline_window(df, -0.25, 0.25).collect()} == {1, 3}


def test_baseline_and_endpoint_rows(spark):
    rows = [
        ("a", 1, 3, 0.101), ("a", 1, 2, 0.104), ("a", 1, 5, 2.0), ("a", 1, 6, 2.001), ("a", 1, 7, None),
        ("f", 1, 0, None), ("f", 1, 6, 0.0), ("f", 1, 24, 1.0), ("f", 1, 30, 9.0),
    ]
    df = spark.createDataFrame(rows, "source string, participant_id int, wave int, time_diagnosis double")
    base = {r["source"]: r["wave"] for r in visits.baseline_row(df, {"f": 0}).collect()}
    end = {r["source"]: r["wave"] for r in visits.endpoint_row(df, {"f": 24}).collect()}
    assert base == {"a": 2, "f": 0} and end == {"a": 5, "f": 24}


def test_positions_do_not_depend_on_buckets(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 2003).alias("o"))
    a = grouping.ordered_index(df, ["g"], ["o"], F.lit(0), "i")
    b = grouping.ordered_index(df, ["g"], ["o"], F.floor(F.col("o") / 50), "i")
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_do_not_depend_on_buckets(spark, descending):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), (F.col("id") / 10).alias("v"), (F.col("id") % 7).alias("n"))
    a = grouping.running_sums(df, ["g"], "v", ["n"], cuts=[], descending=descending)
    b = grouping.running_sums(df, ["g"], "v", ["n"], cuts=[10.0, 33.3, 50.0, 90.0], descending=descending)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()
    odd = df.unionByName(df.sparkSession.sql("SELECT 0L AS g, CAST(NULL AS DOUBLE) AS v, 5L AS n UNION ALL SELECT 1L, double('NaN'), 3L"))
    for cuts in ([], [10.0, 33.3]):
        c = grouping.running_sums(odd, ["g"], "v", ["n"], cuts=cuts, descending=descending)
        assert c.exceptAll(a).count() == 0 and c.count() == a.count()


def test_trajectories_across_buckets(spark, monkeypatch):
    rows = [("a", p, w, w / 4, (w * p) % 2) for p in (1, 2, 3) for w in range(20)]
    df = spark.createDataFrame(rows, "source string, participant_id int, wave int, time_diagnosis double, s int")
    plain = visits.trajectories(df, "s")
    monkeypatch.setattr(visits, "value_cuts", lambda d, c: [1.0, 2.5, 4.0])
    assert visits.trajectories(df, "s").exceptAll(plain).count() == 0
