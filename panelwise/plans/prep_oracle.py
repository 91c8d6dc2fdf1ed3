"""DuckDB equivalents of the preparation queries."""

from __future__ import annotations

from panelwise.plans.oracle_views import CLEAN, HARMONISED, MODEL_TABLE, PANEL, SCORED

ID = "source, participant_id, wave, row_id"


def panel(select: str, ctes: str = "") -> str:
    return f"WITH {PANEL}{ctes} {select}"


def clean(select: str, ctes: str = "") -> str:
    return f"WITH {CLEAN}{ctes} {select}"


SPANNED = """, spanned AS (
  SELECT *, max(round_even(time_diagnosis, 1)) OVER g - min(round_even(time_diagnosis, 1)) OVER g AS span,
    min(round_even(time_diagnosis, 2)) OVER g AS t_min, max(round_even(time_diagnosis, 2)) OVER g AS t_max,
    round_even(time_diagnosis, 2) AS t2
  FROM clean WINDOW g AS (PARTITION BY source, participant_id))"""

FA_CAT = "CASE WHEN fa >= 40 THEN 1 WHEN fa < 40 THEN 0 END"


def one_row(end: str, fixed: int) -> str:
    """First row by wave among those at the extreme time; a fixed wave for BUILDING."""
    return f"""(SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY source, participant_id ORDER BY wave) AS rn FROM spanned
      WHERE CASE WHEN source = 'BUILDING' THEN wave = {fixed} ELSE t2 = {end} END) WHERE rn = 1)"""


def donor(column: str, wave: int) -> str:
    return f"max(CASE WHEN wave = {wave} THEN {column} END) OVER (PARTITION BY source, participant_id)"


def profile(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, round(CAST(min({c}) AS DOUBLE), 6) AS min,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median,
        round(avg({c}), 6) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3,
        round(CAST(max({c}) AS DOUBLE), 6) AS max, count(*) - count({c}) AS nulls FROM clean""" for c in columns
    )


NUMERIC = ["time_dx_days", "education", "smoking", "alcoholuse", "bmi", "age_questionnaire", "fa", "time_diagnosis"]
STEPS = ["start", "any_answer", "followed", "early", "outcome", "not_stage_4"]

EFFECTS = f"""{SCORED}, feats AS (
  SELECT imp, y, p AS score, o_totalprice / 5000 AS fa, CAST(o_custkey % 60 AS DOUBLE) AS age,
    CAST(o_orderkey % 4 AS DOUBLE) AS stage, CAST(o_orderkey % 3 AS DOUBLE) AS smoking
  FROM scored JOIN orders ON row_id = o_orderkey),
long AS (SELECT imp, y, feature, v FROM feats UNPIVOT (v FOR feature IN (score, fa, age, stage, smoking))),
effects AS (
  SELECT imp, feature, avg(v) FILTER (WHERE y = 1) - avg(v) FILTER (WHERE y = 0) AS coef
  FROM long GROUP BY imp, feature)"""

ORACLE = {
    "typed_load": """SELECT o_orderkey, CAST(o_custkey AS INT) AS o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice,
        TRY_CAST(o_orderpriority AS DOUBLE) AS o_orderpriority FROM orders""",
    "mutate_chain": panel(f"""SELECT {ID}, time_dx_days, round(years, 6) AS time_diagnosis,
        round(age_questionnaire + years, 6) AS age_now
        FROM (SELECT * REPLACE (CASE WHEN time_dx_days >= 0 THEN time_dx_days END AS time_dx_days),
              CASE WHEN time_dx_days >= 0 THEN time_dx_days / 365::DOUBLE END AS years FROM panel)"""),
    "recode_columns": panel(f"""SELECT {ID}, CASE WHEN education NOT IN (98, 99) THEN education END AS education,
        CASE WHEN smoking NOT IN (98, 99) THEN smoking END AS smoking,
        CASE WHEN alcoholuse NOT IN (98, 99) THEN alcoholuse END AS alcoholuse FROM panel"""),
    "project_columns": panel("SELECT source, participant_id, wave, row_id, education, smoking FROM panel"),
    "relocate_column": panel(f"""SELECT {ID}, tumortype, stage,
        'source,participant_id,wave,row_id,tumortype,stage' AS column_order FROM panel"""),
    "conditional_update": panel(f"""SELECT {ID},
        CAST(CASE WHEN source = 'BUILDING' AND smoking = 99 THEN 0 ELSE smoking END AS INT) AS smoking,
        CAST(CASE WHEN wave = 1 THEN 1 ELSE under_treatment END AS INT) AS under_treatment FROM panel"""),
    "cohort_filter": panel(f"SELECT {ID}, stage FROM panel WHERE source <> 'MACHINERY'"),
    "any_not_null": clean(f"""SELECT {ID}, education, smoking, round(fa, 6) AS fa, round(bmi, 6) AS bmi FROM clean
        WHERE CASE WHEN source = 'BUILDING' THEN fa IS NOT NULL OR bmi IS NOT NULL
              ELSE education IS NOT NULL OR smoking IS NOT NULL END"""),
    "followup_window": clean(f"""SELECT {ID}, round(time_diagnosis, 6) AS time_diagnosis FROM spanned
        WHERE span BETWEEN 4 AND 6""", SPANNED),
    "baseline_window": clean(f"""SELECT {ID}, round(time_diagnosis, 6) AS time_diagnosis FROM spanned
        WHERE t_min BETWEEN -0.25 AND 0.25""", SPANNED),
    "complete_cases": clean(f"""SELECT {ID}, round(fa, 6) AS fa, under_treatment, round(time_diagnosis, 6) AS time_diagnosis
        FROM clean WHERE fa IS NOT NULL AND under_treatment IS NOT NULL AND time_diagnosis IS NOT NULL"""),
    "exclude_category": clean(f"SELECT {ID}, stage FROM clean WHERE row_id % 7 <> 0 AND stage <> 4"),
    "attrition_report": clean(
        "SELECT coalesce(source, 'ALL') AS source, step_no, step, participants, "
        "round(participants * 100.0::DOUBLE / max(participants) OVER (PARTITION BY source), 4) AS pct_of_start FROM ("
        + " UNION ALL ".join(
            f"""SELECT source, CAST({i} AS INT) AS step_no, '{s}' AS step,
                count(DISTINCT participant_id) FILTER (WHERE ok >= {i}) AS participants
                FROM passed GROUP BY ROLLUP (source)""" for i, s in enumerate(STEPS)) + ")",
        SPANNED + """, passed AS (
          SELECT source, participant_id, CASE
            WHEN coalesce(education, smoking, alcoholuse) IS NULL THEN 0
            WHEN NOT coalesce(span BETWEEN 4 AND 6, FALSE) THEN 1
            WHEN NOT coalesce(t_min BETWEEN -0.25 AND 0.25, FALSE) THEN 2
            WHEN fa IS NULL THEN 3 WHEN stage = 4 THEN 4 ELSE 5 END AS ok FROM spanned)"""),
    "sentinel_to_null": panel(f"""SELECT {ID}, nullif(nullif(education, 98), 99) AS education,
        nullif(nullif(smoking, 98), 99) AS smoking, nullif(alcoholuse, 99) AS alcoholuse FROM panel"""),
    "range_to_null": panel(f"""SELECT {ID}, CASE WHEN NOT (bmi > 251.1 OR bmi < 6.7) THEN round(bmi, 6) END AS bmi,
        CASE WHEN NOT time_dx_days < 0 THEN time_dx_days END AS time_dx_days,
        CASE WHEN NOT fa > 100 THEN round(fa, 6) END AS fa,
        CASE WHEN NOT age_questionnaire > 122 THEN age_questionnaire END AS age_questionnaire FROM panel"""),
    "cross_invalidate": panel(f"""SELECT {ID}, CASE WHEN NOT age > 122 THEN time_dx_days END AS time_dx_days,
        CASE WHEN NOT age > 122 THEN age END AS age_questionnaire
        FROM (SELECT *, CASE WHEN row_id % 8 <> 0 THEN age_questionnaire END AS age FROM panel)"""),
    "default_fill": clean(f"""SELECT {ID}, coalesce(smoking, 0) AS smoking,
        CASE WHEN under_treatment IS NULL AND wave = 3 THEN 0 ELSE under_treatment END AS under_treatment FROM clean"""),
    "coalesce_columns": clean(f"SELECT {ID}, coalesce(education, smoking) AS merged FROM clean"),
    "derive_units": clean(f"""SELECT {ID}, round(time_dx_days / 365::DOUBLE, 6) AS years, round(wave / 12::DOUBLE, 6) AS visit_years,
        round(coalesce(CAST(CASE WHEN row_id % 4 <> 0 THEN time_dx_days END AS DOUBLE), time_diagnosis * 365), 4) AS days_filled
        FROM clean"""),
    "if_else_null": clean(f"""SELECT {ID}, CASE WHEN time_dx_days > 700 THEN 'late' WHEN time_dx_days <= 700 THEN 'early' END AS phase
        FROM clean"""),
    "interval_flag_fill": clean(f"""SELECT {ID}, CASE WHEN under_treatment IS NULL AND wave = 1 THEN
        CAST(time_dx_end_treatment_days - time_dx_start_treatment_days >= time_dx_days AS INT)
        ELSE under_treatment END AS under_treatment FROM clean"""),
    "under_treatment_flag": clean(f"""SELECT {ID}, CASE WHEN s IS NULL AND e IS NULL THEN NULL
        ELSE coalesce(under_treatment, CAST(s <= time_dx_days AND e >= time_dx_days AS INT)) END AS under_treatment
        FROM (SELECT *, CASE WHEN row_id % 3 <> 0 THEN time_dx_start_treatment_days END AS s,
              CASE WHEN row_id % 5 <> 0 THEN time_dx_end_treatment_days END AS e FROM clean)"""),
    "round_derive": clean(f"""SELECT {ID}, round_even(age_questionnaire + time_diagnosis, 0) AS age_by_time,
        round_even(age_questionnaire + wave / 12::DOUBLE, 0) AS age_by_wave, round_even(wave / 2::DOUBLE, 0) AS half_wave,
        round_even(time_diagnosis, 2) AS time_2 FROM clean"""),
    "negative_fix": panel(f"""SELECT {ID}, round(CASE WHEN time_dx_days < 0 THEN wave / 12::DOUBLE
        ELSE CAST(time_dx_days AS DOUBLE) END, 6) AS time_fixed FROM panel"""),
    "outcome_flag": clean(f"""SELECT {ID}, {FA_CAT} AS fa_cat,
        CASE WHEN fa > 39 THEN 1 WHEN fa <= 39 THEN 0 END AS fa_cat_strict FROM clean"""),
    "cohort_binarise": clean(f"""SELECT {ID}, CAST(CASE WHEN source = 'BUILDING' THEN alcoholuse = 1 ELSE alcoholuse > 1 END AS INT)
        AS alcoholuse FROM clean"""),
    "merge_levels": panel(f"SELECT {ID}, CASE WHEN tumortype = 8 THEN 7 ELSE tumortype END AS tumortype FROM panel"),
    "remap_keys": panel("""SELECT source, CASE WHEN source <> 'BUILDING' THEN pid ELSE coalesce(CASE pid
        WHEN 484 THEN 14 WHEN 485 THEN 46 WHEN 486 THEN 114 WHEN 487 THEN 198 WHEN 488 THEN 240 WHEN 489 THEN 250
        WHEN 490 THEN 275 WHEN 491 THEN 312 WHEN 492 THEN 325 WHEN 494 THEN 338 WHEN 495 THEN 349 WHEN 496 THEN 389
        ELSE pid END, 415) END AS participant_id, wave, row_id
        FROM (SELECT *, CASE WHEN row_id % 50 <> 0 THEN participant_id END AS pid FROM panel)"""),
    "factor_encode": """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INT) AS o_orderpriority_code,
        CAST(dense_rank() OVER (ORDER BY o_orderstatus) AS INT) AS o_orderstatus_code FROM orders""",
    "carry_from_baseline": clean(f"SELECT {ID}, " + ", ".join(
        f"CASE WHEN {c} IS NULL AND wave <> 1 THEN {donor(c, 1)} ELSE {c} END AS {c}"
        for c in ("education", "smoking", "alcoholuse")) + " FROM clean"),
    "carry_with_offset": clean(f"""SELECT {ID}, round(CASE WHEN time_diagnosis IS NULL AND wave = 3 THEN {donor('time_diagnosis', 1)} + 1
        WHEN time_diagnosis IS NULL AND wave = 4 THEN {donor('time_diagnosis', 1)} + 2 ELSE time_diagnosis END, 6) AS time_diagnosis
        FROM clean"""),
    "carry_chained": clean(f"""SELECT {ID}, round(CASE WHEN time_diagnosis IS NULL AND wave = 4 THEN {donor('time_diagnosis', 3)} + 1
        ELSE time_diagnosis END, 6) AS time_diagnosis FROM step1""", f""", step1 AS (
        SELECT * REPLACE (CASE WHEN time_diagnosis IS NULL AND wave = 3 THEN {donor('time_diagnosis', 1)} + 1
        ELSE time_diagnosis END AS time_diagnosis) FROM clean)"""),
    "carry_any_wave": clean(f"SELECT {ID}, coalesce(age_questionnaire, {donor('age_questionnaire', 2)}) AS age_questionnaire FROM clean"),
    "harmonise_cohorts": f"""WITH {HARMONISED} SELECT {ID}, round(time_dx_days, 6) AS time_dx_days,
        round(time_diagnosis, 6) AS time_diagnosis, time_dx_end_treatment_days, age_diagnosis, age_questionnaire,
        under_treatment, education, partner, smoking, alcoholuse FROM harmonised""",
    "model_table": f"""WITH {MODEL_TABLE} SELECT source, participant_id, wave,
        CASE WHEN tumortype = 8 THEN 7 ELSE tumortype END AS tumortype, stage, radiotherapy, surgery, systemic, sex, round(bmi, 6) AS bmi,
        {', '.join(f'round(fa, 6) AS {s}' for s in ('ql', 'pf', 'rf', 'ef', 'cf', 'fa', 'nv', 'pa', 'dy', 'sl', 'ap', 'co', 'di'))},
        round(sf, 6) AS sf, round(fi, 6) AS fi, age_diagnosis, round(time_dx_days, 6) AS time_dx_days, time_dx_start_treatment_days, under_treatment,
        age_questionnaire, education, partner, smoking, alcoholuse, fa_cat_end
        FROM treated WHERE under_treatment IS NOT NULL AND stage <> 4""",
    "baseline_endpoint": clean(f"""SELECT b.source, b.participant_id, b.row_id, b.stage, b.tumortype,
        CASE WHEN b.fa >= 40 THEN 1 WHEN b.fa < 40 THEN 0 END AS fa_cat_base,
        CASE WHEN e.fa >= 40 THEN 1 WHEN e.fa < 40 THEN 0 END AS fa_cat_end
        FROM {one_row('t_min', 1)} b JOIN {one_row('t_max', 8)} e
          ON b.source = e.source AND b.participant_id = e.participant_id""", SPANNED),
    "baseline_endpoint_rate": clean(f"""SELECT b.source, b.cat AS fa_cat_base, count(*) AS n, round(avg(e.cat), 6) AS rate,
          count(b.education_carried) AS known_education
        FROM (SELECT *, {FA_CAT} AS cat FROM kept WHERE t2 = t_min
              QUALIFY row_number() OVER (PARTITION BY source, participant_id ORDER BY wave) = 1) b
        JOIN (SELECT *, {FA_CAT} AS cat FROM kept WHERE t2 = t_max
              QUALIFY row_number() OVER (PARTITION BY source, participant_id ORDER BY wave) = 1) e
          ON b.source = e.source AND b.participant_id = e.participant_id
        WHERE b.cat IS NOT NULL AND e.cat IS NOT NULL GROUP BY 1, 2""",
        SPANNED + f""", kept AS (SELECT *, CASE WHEN education IS NULL AND wave <> 1 THEN {donor('education', 1)} ELSE education END
          AS education_carried FROM spanned WHERE span BETWEEN 4 AND 6 AND t_min BETWEEN -0.25 AND 0.25)"""),
    "dataset_overview": panel("""SELECT count(DISTINCT participant_id) AS participants, count(*) AS rows,
        CAST(16 AS INT) AS columns FROM panel"""),
    "column_profile": clean(profile(NUMERIC)),
    "level_counts": clean("SELECT education AS level, count(*) AS n FROM clean GROUP BY 1"),
    "missing_report": clean(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM clean" for c in NUMERIC)),
    "outcome_by_cohort": clean(f"""SELECT fa_cat, source, count(*) AS n,
        round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY source) AS DOUBLE), 6) AS share
        FROM (SELECT source, {FA_CAT} AS fa_cat FROM clean) WHERE fa_cat IS NOT NULL GROUP BY 1, 2"""),
    "apply_columns": clean(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean FROM clean" for c in NUMERIC)),
    "histogram": clean("""SELECT metric, bin, round(low + bin * w, 6) AS bin_start, count(*) AS n FROM (
          SELECT metric, low, w, CAST(least(floor((value - low) / w), k - 1) AS INT) AS bin
          FROM long JOIN (SELECT *, (high - low) / k AS w FROM (
            SELECT metric, min(value) AS low, max(value) AS high, CAST(ceil(log2(count(*))) + 1 AS INT) AS k FROM long GROUP BY metric))
          USING (metric)) GROUP BY 1, 2, 3""",
        ", long AS (SELECT metric, value FROM clean UNPIVOT (value FOR metric IN (bmi, fa, time_diagnosis)))"),
    "group_span": clean(f"""SELECT {ID}, round(span, 6) AS time_elapsed, t_min AS time_min, t_max AS time_max FROM spanned""", SPANNED),
    "first_per_key": clean(f"""SELECT {ID}, round(fa, 6) AS fa, stage, tumortype FROM clean WHERE fa IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY source, participant_id ORDER BY wave) = 1"""),
    "baseline_row": clean(f"SELECT {ID}, round(time_diagnosis, 6) AS time_diagnosis, stage FROM {one_row('t_min', 1)}", SPANNED),
    "endpoint_row": clean(f"SELECT {ID}, round(time_diagnosis, 6) AS time_diagnosis, stage FROM {one_row('t_max', 8)}", SPANNED),
    "trajectories": clean("""SELECT source, participant_id, wave, round(time_diagnosis, 6) AS time_diagnosis, fa_cat,
        row_number() OVER w AS seq, lag(fa_cat) OVER w AS previous
        FROM states WINDOW w AS (PARTITION BY source, participant_id ORDER BY time_diagnosis, wave)""",
        f""", states AS (SELECT * FROM (SELECT *, {FA_CAT} AS fa_cat FROM clean)
             WHERE fa_cat IS NOT NULL AND time_diagnosis IS NOT NULL)"""),
    "sorted_panel": panel(f"SELECT {ID}, stage FROM panel ORDER BY participant_id, wave"),
    "union_cohorts": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS part FROM orders",
    "coef_wide": f"WITH {EFFECTS} SELECT feature, " + ", ".join(
        f"round(max(coef) FILTER (WHERE imp = {i}), 6) AS imp_{i}" for i in range(1, 11)) + " FROM effects GROUP BY feature",
    "coef_summary": f"""WITH {EFFECTS} SELECT feature, round(avg(coef), 6) AS mean, round(stddev_samp(coef), 6) AS sd, count(*) AS n
        FROM effects GROUP BY feature""",
    "top_features": f"""WITH {EFFECTS} SELECT feature, round(avg(abs(coef)), 6) AS importance
        FROM effects GROUP BY feature ORDER BY importance DESC, feature LIMIT 3""",
}
