"""DuckDB text of the shared views: an independent statement of what views.py derives."""

from __future__ import annotations

MASK_32, MIX_MULTIPLIER = 4294967295, 73244475


def hash_uniform(seed: int, *keys: str) -> str:
    parts = ", ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8)) AS BIGINT) / 4294967296::DOUBLE)"


def mix_uniform(source: str, name: str, seed: int, *keys: str) -> str:
    """A subquery over ``source`` (a table or parenthesised query) with the extra column."""
    q = source
    h = f"{(seed * 2654435761 + 97) % 4294967296}::BIGINT"
    for i, k in enumerate(keys):
        k = f"CAST({k} AS BIGINT)"
        first = f"xor({h}, xor({k}, {k} >> 32) & {MASK_32})"
        q = f"(SELECT * {'EXCLUDE (_mix)' if i else ''}, {first} AS _mix FROM {q})"
        for shift, add in ((16, 0), (15, i + 1)):
            q = (
                f"(SELECT * REPLACE ((xor(_mix, _mix >> {shift}) * {MIX_MULTIPLIER} + {add}) & {MASK_32} AS _mix)"
                f" FROM {q})"
            )
        h = "_mix"
    return f"(SELECT * EXCLUDE (_mix), xor(_mix, _mix >> 16) / 4294967296::DOUBLE AS {name} FROM {q})"


VISITS = """visits AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS visit,
         min(o_orderdate) OVER (PARTITION BY o_custkey) AS first_date
  FROM orders)"""

PANEL = VISITS + """,
panel AS (
  SELECT c_mktsegment AS source, o_custkey AS participant_id, visit AS wave, o_orderkey AS row_id,
    CAST(CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE date_diff('day', first_date, o_orderdate) END AS INT) AS time_dx_days,
    CASE WHEN substr(o_orderpriority, 1, 1) = '4' THEN 98 ELSE TRY_CAST(substr(o_orderpriority, 1, 1) AS INT) END AS education,
    CAST(CASE WHEN o_orderkey % 10 = 0 THEN 99 ELSE o_orderkey % 3 END AS INT) AS smoking,
    CAST(CASE WHEN o_orderkey % 13 = 0 THEN 99 ELSE 1 + o_orderkey % 4 END AS INT) AS alcoholuse,
    o_totalprice / 2000 AS bmi,
    CAST(CASE WHEN o_orderkey % 17 = 0 THEN 999 ELSE 20 + o_custkey % 60 END AS INT) AS age_questionnaire,
    CASE WHEN o_orderkey % 19 = 0 THEN 999::DOUBLE ELSE o_totalprice / 5000 END AS fa,
    CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 99 END AS INT) AS under_treatment,
    CAST(1 + o_orderkey % 4 AS INT) AS stage, CAST(1 + o_custkey % 8 AS INT) AS tumortype,
    CAST(o_orderkey % 400 AS INT) AS time_dx_start_treatment_days,
    CAST(o_orderkey % 400 + o_custkey % 700 AS INT) AS time_dx_end_treatment_days
  FROM visits JOIN customer ON o_custkey = c_custkey)"""

CLEAN = PANEL + """,
recoded AS (
  SELECT * REPLACE (
    CASE WHEN age_questionnaire <= 122 AND time_dx_days >= 0 THEN time_dx_days END AS time_dx_days,
    CASE WHEN education NOT IN (98, 99) THEN education END AS education,
    CASE WHEN smoking NOT IN (98, 99) THEN smoking END AS smoking,
    CASE WHEN alcoholuse <> 99 THEN alcoholuse END AS alcoholuse,
    CASE WHEN bmi BETWEEN 6.7 AND 251.1 THEN bmi END AS bmi,
    CASE WHEN age_questionnaire <= 122 THEN age_questionnaire END AS age_questionnaire,
    CASE WHEN fa <= 100 THEN fa END AS fa,
    CASE WHEN under_treatment <> 99 THEN under_treatment END AS under_treatment)
  FROM panel),
clean AS (SELECT *, time_dx_days / 365::DOUBLE AS time_diagnosis FROM recoded)"""

SCORED = f"""scored AS (
  SELECT o_orderkey AS row_id, CAST(o_orderkey % 10 + 1 AS INT) AS imp, CAST(o_orderstatus = 'F' AS INT) AS y,
    round(0.1::DOUBLE + 0.3::DOUBLE * CAST(o_orderstatus = 'F' AS INT)
          + 0.5::DOUBLE * {hash_uniform(1, 'o_orderkey')}, 3) AS p
  FROM orders)"""

TRAIN = PANEL + f""",
train AS (
  SELECT source, participant_id, row_id, fa, bmi, CAST(least(age_questionnaire, 122) AS DOUBLE) AS age_questionnaire,
    education, stage, tumortype,
    CAST(0.6::DOUBLE * fa / 100 + 0.2::DOUBLE * CAST(stage = 1 AS INT)
         + 0.2::DOUBLE * {hash_uniform(2, 'row_id')} >= 0.55::DOUBLE AS INT) AS y
  FROM (SELECT *, row_number() OVER (PARTITION BY source, participant_id ORDER BY wave) AS rn
        FROM panel WHERE fa <= 100) WHERE rn = 1)"""

TRAIN_MISSING = TRAIN + f""",
gaps AS (
  SELECT * REPLACE (
    CASE WHEN {hash_uniform(3, 'row_id')} >= 0.1 THEN bmi END AS bmi,
    CASE WHEN {hash_uniform(4, 'row_id')} >= 0.1 THEN fa END AS fa,
    CASE WHEN {hash_uniform(5, 'row_id')} >= 0.1 THEN education END AS education)
  FROM train)"""

_FA = "CASE WHEN k % 37 = 0 THEN NULL ELSE price / 5000 END"

STUDY = VISITS + f""",
b AS (
  SELECT o_orderkey AS k, o_custkey AS c, visit AS v, o_totalprice AS price,
    CAST(date_diff('day', first_date, o_orderdate) * 2 // 5 AS INT) AS days FROM visits),
raw AS (
  SELECT CASE WHEN c % 6 = 1 AND k % 23 = 0 THEN NULL ELSE
      CASE c % 6 WHEN 0 THEN 'PLCRC' WHEN 1 THEN 'procore' WHEN 2 THEN 'lymphoma' WHEN 3 THEN 'rogy'
        WHEN 4 THEN 'blazib' ELSE 'prozib' END END AS source,
    CASE WHEN c = 415 THEN NULL ELSE c END AS participant_id,
    CAST(CASE WHEN c % 6 = 4 THEN CASE v WHEN 1 THEN 0 WHEN 2 THEN 6 WHEN 3 THEN 12 WHEN 4 THEN 24 ELSE 24 + v END
      ELSE v END AS INT) AS wave,
    k AS row_id,
    CAST(CASE WHEN k % 3 = 0 THEN NULL WHEN k % 41 = 0 THEN -3 ELSE days END AS DOUBLE) AS time_dx_days,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 31 = 0 THEN -1::DOUBLE ELSE days / 365::DOUBLE END AS time_diagnosis,
    CAST(CASE WHEN k % 9 = 0 THEN NULL ELSE k % 400 END AS DOUBLE) AS time_dx_start_treatment_days,
    CAST(CASE WHEN k % 9 = 0 OR k % 4 = 1 THEN NULL ELSE k % 400 + c % 700 END AS DOUBLE) AS time_dx_end_treatment_days,
    CAST(CASE WHEN k % 8 = 0 THEN NULL WHEN k % 6 = 0 THEN 98 ELSE k % 5 END AS INT) AS education,
    CAST(CASE WHEN k % 7 = 0 THEN NULL ELSE k % 2 END AS INT) AS partner,
    CAST(CASE WHEN k % 10 = 0 THEN 99 ELSE k % 3 END AS INT) AS smoking,
    CAST(CASE WHEN k % 13 = 0 THEN 99 ELSE 1 + k % 3 END AS INT) AS alcoholuse,
    price / 2000 AS bmi,
    CAST(CASE WHEN k % 4 = 0 THEN NULL ELSE 20 + c % 60 END AS DOUBLE) AS age_diagnosis,
    CAST(CASE WHEN k % 17 = 0 THEN 999 WHEN c % 6 IN (3, 4) AND k % 6 = 0 THEN NULL
      ELSE 20 + c % 60 + v END AS DOUBLE) AS age_questionnaire,
    CAST(CASE WHEN k % 3 = 1 THEN NULL ELSE k % 2 END AS INT) AS under_treatment,
    CAST(CASE WHEN c % 2 = 0 THEN NULL ELSE 1 + k % 4 END AS INT) AS stage_tnm,
    CAST(CASE WHEN c % 2 = 0 THEN 1 + k % 4 ELSE NULL END AS INT) AS stage_annarbor,
    CAST(1 + c % 8 AS INT) AS tumortype, CAST(k % 2 AS INT) AS radiotherapy, CAST(1 + c % 2 AS INT) AS sex,
    CAST(CASE WHEN k % 11 = 0 THEN NULL ELSE k % 2 END AS INT) AS surgery,
    CAST(CASE WHEN k % 12 = 0 THEN NULL ELSE c % 2 END AS INT) AS systemic,
    {_FA} AS fa,
    CASE WHEN k % 19 = 0 THEN 999::DOUBLE ELSE price / 6000 END AS sf,
    CASE WHEN k % 29 = 0 THEN 999::DOUBLE ELSE price / 7000 END AS fi,
    CASE WHEN k % 37 = 0 THEN NULL ELSE k % 4 END AS item
  FROM b),
s0 AS (
  SELECT * EXCLUDE (stage_tnm, stage_annarbor) REPLACE (
      coalesce(source, 'procore') AS source,
      CASE WHEN age_questionnaire <= 122 AND time_diagnosis >= 0 THEN time_diagnosis END AS time_diagnosis,
      CASE WHEN age_questionnaire <= 122 THEN time_dx_days END AS time_dx_days,
      CASE WHEN age_questionnaire <= 122 THEN age_questionnaire END AS age_questionnaire,
      CASE WHEN education NOT IN (98, 99) THEN education END AS education,
      CASE WHEN smoking NOT IN (98, 99) THEN smoking END AS smoking,
      CASE WHEN alcoholuse <> 99 THEN alcoholuse END AS alcoholuse,
      CASE WHEN bmi BETWEEN 6.7 AND 251.1 THEN bmi END AS bmi,
      CASE WHEN sf <= 100 THEN sf END AS sf, CASE WHEN fi <= 100 THEN fi END AS fi,
      CASE WHEN coalesce(source, 'procore') = 'procore' THEN coalesce(participant_id, 415)
        ELSE participant_id END AS participant_id),
    coalesce(stage_annarbor, stage_tnm) AS stage
  FROM raw),
"""


def _step(src: str, out: str, replaces: dict[str, list[tuple[str, str, str]]], donor_from: str | None = None) -> str:
    """One table-to-table statement; dK.x is x at visit K of the same participant in ``donor_from``."""
    waves = sorted({int(w) for rules in replaces.values() for *_, v in rules for w in (0, 1, 2, 12) if f"d{w}." in v})
    joins = "".join(
        f" LEFT JOIN {donor_from or src} d{w} ON d{w}.source = p.source AND d{w}.participant_id = p.participant_id"
        f" AND d{w}.wave = {w}" for w in waves
    )
    reps = []
    for c, rules in replaces.items():
        whens = " ".join(f"WHEN p.source = '{s}' AND {cond} THEN {v}" for s, cond, v in rules)
        reps.append(f"CASE {whens} ELSE p.{c} END AS {c}")
    return f"{out} AS (SELECT p.* REPLACE ({', '.join(reps)}) FROM {src} p{joins})"


def _null(c: str, more: str = "") -> str:
    return f"p.{c} IS NULL" + (f" AND {more}" if more else "")


def _social() -> dict:
    who = {
        "procore": (1, "education partner smoking alcoholuse"), "lymphoma": (1, "education partner smoking alcoholuse"),
        "rogy": (1, "education partner smoking alcoholuse"), "blazib": (0, "education partner smoking alcoholuse"),
        "prozib": (1, "education smoking alcoholuse"), "PLCRC": (1, "education partner smoking"),
    }
    out: dict = {}
    for s, (w, cols) in who.items():
        for c in cols.split():
            out.setdefault(c, []).append((s, _null(c, f"p.wave <> {w}"), f"d{w}.{c}"))
    return out


_T, _D, _A, _U = "time_diagnosis", "time_dx_days", "age_questionnaire", "under_treatment"
_LONG = ("CASE WHEN p.time_dx_end_treatment_days - p.time_dx_start_treatment_days >= p.time_diagnosis THEN 1"
         " WHEN p.time_dx_end_treatment_days - p.time_dx_start_treatment_days < p.time_diagnosis THEN 0 END")
_ALWAYS = [(s, "TRUE", "p.time_dx_days / 365") for s in ("procore", "blazib", "prozib")]

HARMONISED = STUDY + ",\n".join([
    _step("s0", "s1", {_T: _ALWAYS, "age_diagnosis": [("lymphoma", _null("age_diagnosis"), "d2.age_diagnosis")]}),
    _step("s1", "s2", {
        _T: [("procore", _null(_T, "p.wave = 4"), f"d1.{_T} + 2"), ("procore", _null(_T, "p.wave = 3"), f"d1.{_T} + 1"),
             ("rogy", _null(_T, "p.wave = 2"), f"d1.{_T} + 0.5"), ("rogy", _null(_T, "p.wave = 3"), f"d1.{_T} + 1"),
             ("blazib", _null(_T, "p.wave = 6"), f"d0.{_T} + 0.5"), ("blazib", _null(_T, "p.wave = 12"), f"d0.{_T} + 1"),
             ("prozib", _null(_T, "p.wave = 3"), f"d2.{_T} + 1")],
        _A: [("prozib", _null(_A, "p.wave = 3"), f"d2.{_A} + 1")],
        "time_dx_end_treatment_days": [("procore", _null("time_dx_end_treatment_days", "p.wave <> 1"), "d1.time_dx_end_treatment_days")],
    }),
    _step("s2", "s3", {
        _T: [("rogy", _null(_T, "p.wave = 5"), f"d1.{_T} + 2"), ("rogy", _null(_T, "p.wave = 1"), f"d2.{_T} - 0.5"),
             ("blazib", _null(_T, "p.wave = 24"), f"d12.{_T} + 1")],
    }),
    _step("s3", "s4", {_D: [(s, _null(_D), f"p.{_T} * 365") for s in ("procore", "rogy", "blazib", "prozib")]}),
    _step("s4", "s5", {
        _A: [("rogy", _null(_A), f"round_even(p.age_diagnosis + p.{_T}, 0)"),
             ("blazib", _null(_A), "round_even(p.age_diagnosis + p.wave / 12, 0)")],
        _U: [("rogy", _null(_U, "p.wave = 1"), _LONG), ("blazib", _null(_U), "0"),
             ("prozib", _null(_U, "p.wave = 3"), "0"), ("prozib", _null(_U, "p.wave = 1"), _LONG)],
    }),
    _step("s5", "s6", {_T: [("blazib", f"p.{_T} < 0", "p.wave / 12")]}),
    _step("s6", "s7", {_D: [("blazib", "TRUE", f"p.{_T} * 365")]}),
    _step("s7", "s8", _social()),
]) + """,
harmonised AS (
  SELECT * REPLACE (CASE WHEN source = 'procore' THEN CASE participant_id
      WHEN 484 THEN 14 WHEN 485 THEN 46 WHEN 486 THEN 114 WHEN 487 THEN 198 WHEN 488 THEN 240 WHEN 489 THEN 250
      WHEN 490 THEN 275 WHEN 491 THEN 312 WHEN 492 THEN 325 WHEN 494 THEN 338 WHEN 495 THEN 349 WHEN 496 THEN 389
      ELSE participant_id END ELSE participant_id END AS participant_id)
  FROM s8)"""

MODEL_TABLE = HARMONISED + """,
flagged AS (
  SELECT * REPLACE (CASE WHEN source = 'PLCRC' THEN CASE WHEN alcoholuse = 1 THEN 1 WHEN alcoholuse <> 1 THEN 0 END
      WHEN alcoholuse > 1 THEN 1 WHEN alcoholuse <= 1 THEN 0 END AS alcoholuse),
    CASE WHEN fa >= 40 THEN 1 WHEN fa < 40 THEN 0 END AS fa_cat
  FROM harmonised),
answered AS (
  SELECT *, round_even(time_diagnosis, 1) AS t1, round_even(time_diagnosis, 2) AS t2 FROM flagged
  WHERE CASE WHEN source = 'prozib' THEN fa IS NOT NULL OR sf IS NOT NULL OR fi IS NOT NULL ELSE item IS NOT NULL END
    AND (education IS NOT NULL OR partner IS NOT NULL OR smoking IS NOT NULL OR alcoholuse IS NOT NULL)),
spans AS (
  SELECT *, max(t1) OVER g - min(t1) OVER g AS elapsed, min(t2) OVER g AS t_min, max(t2) OVER g AS t_max
  FROM answered WINDOW g AS (PARTITION BY source, participant_id)),
followed AS (SELECT * FROM spans WHERE elapsed BETWEEN 2 AND 3 AND t_min BETWEEN -0.25 AND 0.25),
base AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, participant_id ORDER BY wave) AS rn FROM followed
    WHERE CASE WHEN source = 'blazib' THEN wave = 0 ELSE t2 = t_min END) WHERE rn = 1),
fin AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, participant_id ORDER BY wave) AS rn FROM followed
    WHERE CASE WHEN source = 'blazib' THEN wave = 24 ELSE t2 = t_max END) WHERE rn = 1),
both_ends AS (
  SELECT base.*, fin.fa_cat AS fa_cat_end FROM base JOIN fin USING (source, participant_id)
  WHERE base.fa_cat IS NOT NULL AND fin.fa_cat IS NOT NULL),
treated AS (
  SELECT * REPLACE (CASE WHEN time_dx_start_treatment_days IS NULL AND time_dx_end_treatment_days IS NULL THEN NULL
    ELSE coalesce(under_treatment, CAST(time_dx_start_treatment_days <= time_dx_days
                                        AND time_dx_end_treatment_days >= time_dx_days AS INT)) END AS under_treatment)
  FROM both_ends)"""
