"""The cancer-survivor study as rules: harmonisation table, flags, exclusions, model table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.functions.expr import (
    any_not_null, cross_invalidate, days_from_years, if_else_null, in_interval_flag, merge_levels,
    range_to_null, round_even, sentinel_to_null, threshold_flag, years_from_days, years_from_months,
)
from panelwise.operators.exclusion import any_answer, exclude_category, remap_keys
from panelwise.operators.harmonise import Rule, harmonise
from panelwise.operators.visits import baseline_endpoint, study_window
from panelwise.session import cut_lineage
from panelwise.sources.load import QUESTIONNAIRE_SCALES

# Codes and bounds of the questionnaire guidebook.
MISSING_CODES = {"education": [98, 99], "smoking": [98, 99], "alcoholuse": [99]}
BOUNDS = {"bmi": (6.7, 251.1), "time_diagnosis": (0, None), "fi": (None, 100), "sf": (None, 100)}
OLDEST_AGE = 122
DEFAULT_SOURCE = "procore"
FATIGUE_ITEMS = ["qlqc30_10", "qlqc30_12", "qlqc30_18"]
SOCIAL = ("education", "partner", "smoking", "alcoholuse")

# Participants of one cohort that share ids with others, and the id of
# its one unnamed participant.
UNNAMED_ID = 415
REMAPPED_IDS = {
    484: 14, 485: 46, 486: 114, 487: 198, 488: 240, 489: 250,
    490: 275, 491: 312, 492: 325, 494: 338, 495: 349, 496: 389,
}

# Visits that serve as baseline and endpoint where visits are dated by code.
BASELINE_VISIT = {"blazib": 0}
ENDPOINT_VISIT = {"blazib": 24}


def _years(read):
    return years_from_days(read("time_dx_days"))


def _days(read):
    return days_from_years(read("time_diagnosis"))


def _treated_long_enough(read):
    length = read("time_dx_end_treatment_days") - read("time_dx_start_treatment_days")
    return if_else_null(length >= read("time_diagnosis"), 1, 0)


_T, _D = ("time_diagnosis",), ("time_dx_days",)

# Which cohort fills what, when, and from which visit. Blocks in order.
COHORT_RULES = [
    Rule("procore", 1, _T, value=_years, always=True),
    Rule("procore", 2, _T, donor=1, offset=2, at=(4,)),
    Rule("procore", 2, _T, donor=1, offset=1, at=(3,)),
    Rule("procore", 2, _D, value=_days),
    Rule("procore", 3, ("time_dx_end_treatment_days",), donor=1, not_at=(1,)),
    Rule("procore", 4, SOCIAL, donor=1, not_at=(1,)),
    Rule("lymphoma", 1, ("age_diagnosis",), donor=2),
    Rule("lymphoma", 2, SOCIAL, donor=1, not_at=(1,)),
    Rule("rogy", 1, _T, donor=1, offset=0.5, at=(2,)),
    Rule("rogy", 1, _T, donor=1, offset=1, at=(3,)),
    Rule("rogy", 2, _T, donor=1, offset=2, at=(5,)),
    Rule("rogy", 2, _T, donor=2, offset=-0.5, at=(1,)),
    Rule("rogy", 2, _D, value=_days),
    Rule("rogy", 3, ("age_questionnaire",), value=lambda r: round_even(r("age_diagnosis") + r("time_diagnosis"))),
    Rule("rogy", 4, ("under_treatment",), value=_treated_long_enough, at=(1,)),
    Rule("rogy", 5, SOCIAL, donor=1, not_at=(1,)),
    Rule("blazib", 1, _T, value=_years, always=True),
    Rule("blazib", 2, _T, donor=0, offset=0.5, at=(6,)),
    Rule("blazib", 2, _T, donor=0, offset=1, at=(12,)),
    Rule("blazib", 3, _T, donor=12, offset=1, at=(24,)),
    Rule("blazib", 3, _D, value=_days),
    Rule("blazib", 4, ("age_questionnaire",), value=lambda r: round_even(r("age_diagnosis") + r("wave") / 12)),
    Rule("blazib", 5, ("under_treatment",), value=lambda r: F.lit(0)),
    Rule("blazib", 6, _T, value=lambda r: years_from_months(r("wave")), test=lambda r: r("time_diagnosis") < 0),
    Rule("blazib", 6, _D, value=_days, always=True),
    Rule("blazib", 7, SOCIAL, donor=0, not_at=(0,)),
    Rule("prozib", 1, _T, value=_years, always=True),
    Rule("prozib", 2, ("time_diagnosis", "age_questionnaire"), donor=2, offset=1, at=(3,)),
    Rule("prozib", 2, _D, value=_days),
    Rule("prozib", 3, ("under_treatment",), value=lambda r: F.lit(0), at=(3,)),
    Rule("prozib", 3, ("under_treatment",), value=_treated_long_enough, at=(1,)),
    Rule("prozib", 4, ("education", "smoking", "alcoholuse"), donor=1, not_at=(1,)),
    Rule("PLCRC", 1, ("education", "partner", "smoking"), donor=1, not_at=(1,)),
]


@dataclass(frozen=True)
class Options:
    """Where study variants differ."""

    outcome_cut: float = 40
    outcome_strict: bool = False
    plcrc_drinks_code_is_one: bool = True
    elapsed: tuple[float, float] = (2, 3)
    first_visit: tuple[float, float] = (-0.25, 0.25)


def recode_study(df: DataFrame) -> DataFrame:
    """Guidebook recodes: codes and implausible values to NULL, one stage column."""
    df = df.withColumns({c: sentinel_to_null(c, codes) for c, codes in MISSING_CODES.items()})
    df = df.withColumns({c: range_to_null(c, low, high) for c, (low, high) in BOUNDS.items()})
    df = df.withColumn("source", F.coalesce("source", F.lit(DEFAULT_SOURCE)))
    df = df.withColumns({
        c: cross_invalidate(c, "age_questionnaire", OLDEST_AGE)
        for c in ("time_diagnosis", "time_dx_days", "age_questionnaire")
    })
    return df.withColumn("stage", F.coalesce("stage_annarbor", "stage_tnm")).drop("stage_annarbor", "stage_tnm")


def harmonise_study(df: DataFrame) -> DataFrame:
    """Cohort rules. The unnamed participant gets an id first, clashing ids are changed last."""
    in_procore = F.col("source") == "procore"
    df = remap_keys(df, "participant_id", {}, where=in_procore, null_to=UNNAMED_ID)
    df = harmonise(df, COHORT_RULES)
    return remap_keys(df, "participant_id", REMAPPED_IDS, where=F.col("source") == "procore")


def flag_study(df: DataFrame, o: Options = Options()) -> DataFrame:
    """Alcohol use to yes/no (one cohort codes it differently) and the outcome."""
    a = F.col("alcoholuse")
    plcrc = if_else_null(a == 1, *((1, 0) if o.plcrc_drinks_code_is_one else (0, 1)))
    drinks = F.when(F.col("source") == "PLCRC", plcrc).otherwise(if_else_null(a > 1, 1, 0))
    return df.withColumns({
        "alcoholuse": drinks,
        "fa_cat": threshold_flag("fa", o.outcome_cut, strict=o.outcome_strict),
    })


def follow_up(df: DataFrame, o: Options = Options()) -> DataFrame:
    """Rows with answers, of participants followed long enough from close to the diagnosis."""
    df = any_answer(df, FATIGUE_ITEMS, {"prozib": QUESTIONNAIRE_SCALES}).where(any_not_null(SOCIAL))
    return study_window(df, o.elapsed, o.first_visit)


# All baseline columns that are predictors, the scales of the questionnaire among them.
SCALES = list(QUESTIONNAIRE_SCALES)
PREDICTORS = [
    "wave", "tumortype", "stage", "radiotherapy", "surgery", "systemic", "bmi", "sex", *SCALES, "time_dx_days",
    "time_dx_start_treatment_days", "time_dx_end_treatment_days", "under_treatment",
    "age_diagnosis", "age_questionnaire", "education", "partner", "smoking", "alcoholuse",
]


def model_table(df: DataFrame, predictors: list[str] = PREDICTORS) -> DataFrame:
    """Baseline predictors with the endpoint outcome, after the last exclusions."""
    t = baseline_endpoint(
        df, "fa_cat", predictors, baseline_fixed=BASELINE_VISIT, endpoint_fixed=ENDPOINT_VISIT
    )
    t = t.dropna(subset=["fa_cat_base", "fa_cat_end"]).drop("fa_cat_base")
    t = t.withColumn("under_treatment", in_interval_flag(
        "under_treatment", "time_dx_start_treatment_days", "time_dx_end_treatment_days", "time_dx_days"
    ))
    t = t.where(F.col("under_treatment").isNotNull()).drop("time_dx_end_treatment_days")
    t = exclude_category(t, "stage", 4)
    return t.withColumn("tumortype", merge_levels("tumortype", {8: 7}))


def prepare_study(raw: DataFrame, o: Options = Options()) -> DataFrame:
    """Raw table to model table. The harmonised table is read three times, so it is written once."""
    harmonised = cut_lineage(harmonise_study(recode_study(raw)))
    return model_table(follow_up(flag_study(harmonised, o), o))
