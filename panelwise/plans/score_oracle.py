"""DuckDB equivalents of the split, bootstrap and validation queries."""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

from panelwise.plans.oracle_views import SCORED, hash_uniform, mix_uniform

REPLICATES, SEED, UNIT = 1000, 7, 65536
GRID, SMALLEST_P, Z_95 = 20, 1e-15, 1.959963984540054
METRICS = ["accuracy", "balanced_accuracy", "precision", "sensitivity", "specificity", "npv", "c_statistic", "r2", "slope"]
POISSON_1_CDF = list(accumulate(exp(-1) / factorial(k) for k in range(13)))
#: Plain Newton steps from intercept and slope 0; all groups have converged well before the last.
NEWTON_STEPS = 12

INDEXED = SCORED + """,
indexed AS (
  SELECT *, row_number() OVER (PARTITION BY imp ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) AS idx,
    count(*) OVER (PARTITION BY imp) AS n_rows FROM scored)"""


def drawn(replicates: int) -> str:
    slots = f"(SELECT imp, idx, n_rows, unnest(generate_series(1, {replicates})) AS replicate FROM indexed)"
    u = mix_uniform(slots, "u", SEED, "imp", "replicate", "idx")
    return INDEXED + f""",
draws AS (SELECT imp, CAST(replicate AS INT) AS replicate, CAST(floor(u * n_rows) + 1 AS BIGINT) AS idx FROM {u}),
drawn AS (SELECT draws.imp, replicate, row_id, p, y, 1 AS weight
          FROM draws JOIN indexed ON draws.imp = indexed.imp AND draws.idx = indexed.idx)"""


def resampled(replicates: int, unit: int = UNIT, p: str = "p", order: str = "p, y DESC") -> str:
    """Draws by units of places: a draw picks a unit, then a place in it."""
    slots = f"""(SELECT imp, n_rows, idx + 1 AS slot, unnest(generate_series(1, {replicates})) AS replicate FROM placed WHERE n_rows > {unit})"""
    picks = f"""(SELECT imp, unit, size, replicate, unnest(generate_series(1, n)) AS k FROM plan)"""
    return SCORED + f""",
placed AS MATERIALIZED (
  SELECT imp, p, y, row_number() OVER (PARTITION BY imp ORDER BY {order}) - 1 AS idx, count(*) OVER (PARTITION BY imp) AS n_rows
  FROM (SELECT * REPLACE ({p} AS p) FROM scored)),
units AS (SELECT imp, idx // {unit} AS unit, count(*) AS size, any_value(n_rows) AS n_rows FROM placed GROUP BY 1, 2),
plan AS (
  SELECT imp, unit, size, replicate, n_rows AS n FROM units, range(1, {replicates + 1}) r(replicate) WHERE n_rows <= {unit}
  UNION ALL
  SELECT imp, unit, size, replicate, n FROM (
    SELECT imp, replicate, CAST(floor(u * n_rows) AS BIGINT) // {unit} AS unit, count(*) AS n
    FROM {mix_uniform(slots, "u", SEED + 7919, "imp", "replicate", "slot")} GROUP BY 1, 2, 3) JOIN units USING (imp, unit)),
drawn AS (
  SELECT imp, CAST(replicate AS INT) AS replicate, p, y, 1 AS weight
  FROM (SELECT imp, replicate, unit * {unit} + CAST(floor(u * size) AS BIGINT) AS idx
        FROM {mix_uniform(picks, "u", SEED, "imp", "replicate", "unit", "k")}) JOIN placed USING (imp, idx))"""


def poisson(replicates: int) -> str:
    slots = f"(SELECT *, unnest(generate_series(1, {replicates})) AS replicate FROM scored)"
    u = mix_uniform(slots, "u", SEED, "imp", "replicate", "row_id")
    whens = " ".join(f"WHEN u < {edge!r}::DOUBLE THEN {k}" for k, edge in enumerate(POISSON_1_CDF))
    return SCORED + f""",
drawn AS (SELECT * FROM (SELECT imp, CAST(replicate AS INT) AS replicate, row_id, p, y,
          CAST(CASE {whens} ELSE {len(POISSON_1_CDF)} END AS BIGINT) AS weight FROM {u}) WHERE weight > 0)"""


def scores(by: str, source: str = "drawn") -> str:
    w = "weight" if source == "drawn" else "1"
    return f"""scores AS MATERIALIZED (SELECT {by}, p, CAST(sum({w} * y) AS BIGINT) AS n1, CAST(sum({w} * (1 - y)) AS BIGINT) AS n0
      FROM {source} GROUP BY {by}, p)"""


def confusion(by: str) -> str:
    def total(test: str, n: str) -> str:
        return f"CAST(coalesce(sum({n}) FILTER (WHERE {test}), 0) AS BIGINT)"

    return f"""confusion AS (SELECT {by}, {total('p >= 0.5', 'n1')} AS tp, {total('p >= 0.5', 'n0')} AS fp,
      {total('p < 0.5', 'n0')} AS tn, {total('p < 0.5', 'n1')} AS fn FROM scores GROUP BY {by})"""


def rates(by: str) -> str:
    return f"""rates AS (SELECT {by}, (tp + tn) / nullif(tp + fp + tn + fn, 0)::DOUBLE AS accuracy,
      (tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE) / 2 AS balanced_accuracy,
      tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS sensitivity,
      tn / nullif(tn + fp, 0)::DOUBLE AS specificity, tn / nullif(tn + fn, 0)::DOUBLE AS npv FROM confusion)"""


def ranked(by: str) -> str:
    return f"""ranked AS (SELECT *, sum(n0) OVER (PARTITION BY {by} ORDER BY p) AS below,
        sum(n1) OVER (PARTITION BY {by} ORDER BY p DESC) AS up1, sum(n0) OVER (PARTITION BY {by} ORDER BY p DESC) AS up0,
        sum(n1) OVER (PARTITION BY {by}) AS t1, sum(n0) OVER (PARTITION BY {by}) AS t0,
        sum(n1 + n0) OVER (PARTITION BY {by} ORDER BY p) - n1 - n0 AS before FROM scores)"""


def cstat(by: str) -> str:
    return f"""cstat AS (SELECT {by}, sum(n1 * (below - n0 / 2::DOUBLE)) / nullif(CAST(sum(n1) AS DOUBLE) * sum(n0), 0) AS c_statistic
      FROM ranked GROUP BY {by})"""


CLAMP = f"least(greatest(p, {SMALLEST_P!r}::DOUBLE), 1 - {SMALLEST_P!r}::DOUBLE)"


def r2(by: str) -> str:
    return f"""lik AS (SELECT {by}, CAST(sum(n1) AS DOUBLE) AS e, CAST(sum(n0) AS DOUBLE) AS o,
        -2 * sum(n1 * ln({CLAMP}) + n0 * ln(1 - {CLAMP})) AS d FROM scores GROUP BY {by}),
      {nagelkerke(by)}"""


def nagelkerke(by: str = "imp") -> str:
    return f"""nag AS (SELECT {by}, (1 - exp((d - d0) / (e + o))) / (1 - exp(-d0 / (e + o))) AS r2
        FROM (SELECT *, CASE WHEN e > 0 AND o > 0 THEN -2 * (e * ln(e / (e + o)) + o * ln(o / (e + o))) END AS d0 FROM lik))"""


def newton(by: str) -> str:
    on = " AND ".join(f"g.{k.strip()} = q.{k.strip()}" for k in by.split(","))
    gby = ", ".join(f"g.{k.strip()}" for k in by.split(","))
    out = [f"logits AS (SELECT {by}, ln({CLAMP} / (1 - {CLAMP})) AS z, n1, n1 + n0 AS w FROM scores)",
           f"q0 AS (SELECT DISTINCT {by}, 0::DOUBLE AS intercept, 0::DOUBLE AS slope FROM scores)"]
    for i in range(1, NEWTON_STEPS + 1):
        out.append(f"""q{i} AS (SELECT {by}, a + (s2 * g0 - s1 * g1) / (s0 * s2 - s1 * s1) AS intercept,
          b + (s0 * g1 - s1 * g0) / (s0 * s2 - s1 * s1) AS slope FROM (
          SELECT {by}, any_value(a) AS a, any_value(b) AS b, sum(v) AS s0, sum(v * z) AS s1, sum(v * z * z) AS s2,
            sum(r) AS g0, sum(r * z) AS g1 FROM (
            SELECT {by}, z, a, b, w * mu * (1 - mu) AS v, n1 - w * mu AS r FROM (
              SELECT {gby}, z, n1, w, intercept AS a, slope AS b, 1 / (1 + exp(-(intercept + slope * z))) AS mu
              FROM logits g JOIN q{i - 1} q ON {on})) GROUP BY {by}))""")
    return ",\n".join(out)


def q(select: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


RATES = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS[:6])
BASE = (SCORED, scores("imp", "scored"))
ROC = """roc AS (SELECT imp, p AS threshold, up1 / CAST(t1 AS DOUBLE) AS tpr, up0 / CAST(t0 AS DOUBLE) AS fpr FROM ranked
  UNION ALL SELECT DISTINCT imp, CAST(NULL AS DOUBLE), 0::DOUBLE, 0::DOUBLE FROM ranked)"""
SUMMARY = """round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.025), 6) AS low,
  round(quantile_cont(value, 0.975), 6) AS high, count(value) AS n FROM long GROUP BY metric"""


def long(metrics: list[str], source: str) -> str:
    return "long AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value FROM {source}" for m in metrics) + ")"


REP = "imp, replicate"
BY_ID = "md5(CAST(row_id AS VARCHAR)), row_id"
SLOPE = "round(intercept, 6) AS intercept, round(slope, 6) AS slope, TRUE AS converged"


def exact_mean(value: str) -> str:
    return f"((2 * CAST(sum(CAST(round(({value}) * 1000000) AS BIGINT)) AS BIGINT) + count(*)) // (2 * count(*))) / 1000000::DOUBLE"


def report(draws: str) -> str:
    wide = f"wide AS (SELECT * FROM rates JOIN cstat USING ({REP}) JOIN nag USING ({REP}) JOIN q{NEWTON_STEPS} USING ({REP}))"
    return q(f"SELECT metric, {SUMMARY}", draws, scores(REP), confusion(REP), rates(REP), ranked(REP), cstat(REP), r2(REP), newton(REP),
             wide, long(METRICS, "wide"))


ORACLE = {
    "train_test_split": q(f"SELECT row_id, imp, {hash_uniform(100, 'row_id')} < 0.7 AS is_train FROM scored", SCORED),
    "train_test_split_per_run": q(f"""SELECT imp, {hash_uniform(100, 'imp', 'row_id')} < 0.8 AS is_train, count(*) AS n
        FROM scored GROUP BY 1, 2""", SCORED),
    "bootstrap_weights": q("SELECT imp, replicate, row_id, count(*) AS weight FROM drawn GROUP BY 1, 2, 3", drawn(10)),
    "bootstrap_weights_poisson": q("SELECT imp, replicate, row_id, weight FROM drawn", poisson(10)),
    "classify_threshold": q("SELECT row_id, imp, y, CAST(p >= 0.5 AS INT) AS predicted FROM scored", SCORED),
    "confusion_matrix": q("SELECT * FROM confusion", *BASE, confusion("imp")),
    "bootstrap_classification": q(f"SELECT {REP}, {RATES} FROM rates", resampled(REPLICATES), scores(REP), confusion(REP), rates(REP)),
    "c_statistic": q("SELECT imp, round(c_statistic, 6) AS c_statistic FROM cstat", *BASE, ranked("imp"), cstat("imp")),
    "nagelkerke_r2": q("SELECT imp, round(r2, 6) AS r2 FROM nag", *BASE, r2("imp")),
    "calibration_slope": q(f"SELECT imp, {SLOPE} FROM q{NEWTON_STEPS}", *BASE, newton("imp")),
    "calibration_slope_extremes": q(f"SELECT imp, {SLOPE} FROM q{NEWTON_STEPS}",
                                    SCORED, f"""extreme AS (SELECT * REPLACE (CASE WHEN noisy < 0.25 THEN 0::DOUBLE WHEN noisy < 0.75 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS p)
                                      FROM (SELECT *, p + {hash_uniform(12, 'row_id')} - 0.5::DOUBLE AS noisy FROM scored))""",
                                    scores("imp", "extreme"), newton("imp")),
    "recalibrated_r2": q("SELECT imp, round(r2, 6) AS r2 FROM nag", *BASE, newton("imp"),
                         f"""lik AS (SELECT imp, CAST(sum(n1) AS DOUBLE) AS e, CAST(sum(n0) AS DOUBLE) AS o, -2 * sum(n1 * ln(mu) + n0 * ln(1 - mu)) AS d
                           FROM (SELECT imp, n1, n0, 1 / (1 + exp(-(intercept + slope * ln({CLAMP} / (1 - {CLAMP}))))) AS mu
                                 FROM scores JOIN q{NEWTON_STEPS} USING (imp)) GROUP BY imp)""", nagelkerke()),
    "roc_curve": q("SELECT imp, threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc", *BASE, ranked("imp"), ROC),
    "roc_average": q(f"""SELECT g / {GRID}::DOUBLE AS fpr, round(avg(tpr), 6) AS mean_tpr, round(stddev_samp(tpr), 6) AS sd_tpr FROM (
        SELECT imp, g, max(tpr) AS tpr FROM roc, range({GRID + 1}) grid(g) WHERE ceil(round(fpr * {GRID}, 9)) <= g GROUP BY 1, 2)
        GROUP BY g""", *BASE, ranked("imp"), ROC),
    "calibration_table": q(f"""SELECT imp, decile, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS observed,
        round((rate + zz / (2 * n)) / (1 + zz / n) - half, 6) AS low, round((rate + zz / (2 * n)) / (1 + zz / n) + half, 6) AS high
        FROM (SELECT *, {Z_95!r}::DOUBLE * sqrt(rate * (1 - rate) / n + zz / (4 * n * n)) / (1 + zz / n) AS half FROM (
          SELECT imp, CAST(floor(10 * before / CAST(t1 + t0 AS DOUBLE)) + 1 AS INT) AS decile,
            CAST(sum(n1 + n0) AS BIGINT) AS n, sum((n1 + n0) * p) / sum(n1 + n0) AS mean_p,
            sum(n1) / CAST(sum(n1 + n0) AS DOUBLE) AS rate, {Z_95!r}::DOUBLE * {Z_95!r}::DOUBLE AS zz
          FROM ranked GROUP BY 1, 2))""", *BASE, ranked("imp")),
    "validation_report": report(resampled(REPLICATES)),
    "validation_report_continuous": report(resampled(REPLICATES, 128, f"round(p + 0.001::DOUBLE * {hash_uniform(11, 'row_id')}, 9)")),
    "metric_summary": q(f"SELECT metric, {SUMMARY}", poisson(REPLICATES), scores(REP), confusion(REP), rates(REP),
                        long(METRICS[:6], "rates")),
    "bootstrap_custom": q(f"""SELECT imp, replicate, {exact_mean('p')} AS mean_risk, {exact_mean('y')} AS event_rate,
        {exact_mean('(p - y) * (p - y)')} AS brier FROM drawn GROUP BY 1, 2""", resampled(REPLICATES, order=BY_ID)),
    "bootstrap_trimmed_mean": q(f"""SELECT imp, replicate, {exact_mean('p')} AS trimmed_mean FROM (
        SELECT *, row_number() OVER (PARTITION BY imp, replicate ORDER BY p) AS place, count(*) OVER (PARTITION BY imp, replicate) AS n FROM drawn)
        WHERE place > n // 10 AND place <= n - n // 10 GROUP BY 1, 2""", resampled(REPLICATES, 128, order=BY_ID)),
}
