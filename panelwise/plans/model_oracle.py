"""DuckDB statements of what must hold of fitted models: rows, folds, optima, sums."""

from __future__ import annotations

from panelwise.plans.oracle_views import TRAIN, TRAIN_MISSING, hash_uniform
from panelwise.plans.score_oracle import METRICS, REP, cstat, newton, confusion, long, r2, ranked, rates, resampled, scores, NEWTON_STEPS, REPLICATES

SPLIT = TRAIN + f""",
training AS (SELECT row_id, CAST(floor({hash_uniform(1, 'row_id', "'fold'")} * 10) AS INT) AS fold FROM train WHERE {hash_uniform(100, 'row_id')} < 0.7)"""
#: Three numbers, and the levels 1, 2, 3, 5, 98 of education, 1 to 4 of stage, 1 to 8 of tumour type.
FEATURES = 3 + 5 + 4 + 8

ORACLE = {
    "lasso_path_check": f"""WITH {SPLIT}, folds AS (SELECT unnest(generate_series(-1, 9)) AS fold)
        SELECT CAST(c AS INT) AS candidate, CAST(f.fold AS INT) AS fold, (SELECT count(*) FROM training t WHERE t.fold <> f.fold) AS n, TRUE AS stationary
        FROM range(100) r(c), folds f""",
    "grid_search_check": f"""WITH {SPLIT} SELECT CAST(c AS INT) AS candidate, fold, count(*) AS n, TRUE AS scored
        FROM training, range(10) r(c) GROUP BY 1, 2""",
    "shap_additivity": f"""WITH {TRAIN} SELECT row_id, CAST({FEATURES} AS BIGINT) AS n, TRUE AS additive
        FROM train WHERE NOT {hash_uniform(100, 'row_id')} < 0.7""",
    "forest_impute_check": f"""WITH {TRAIN_MISSING} SELECT row_id, round(fa, 6) AS fa, round(bmi, 6) AS bmi, education, TRUE AS filled FROM gaps""",
    "replicate_histograms": f"""WITH {resampled(REPLICATES)}, {scores(REP)}, {confusion(REP)}, {rates(REP)}, {ranked(REP)}, {cstat(REP)}, {r2(REP)}, {newton(REP)},
        wide AS (SELECT {', '.join(f'round({m}, 9) AS {m}' for m in METRICS)} FROM rates JOIN cstat USING ({REP}) JOIN nag USING ({REP}) JOIN q{NEWTON_STEPS} USING ({REP})),
        {long(METRICS, 'wide')},
        span AS (SELECT metric, min(value) AS low, max(value) AS high, CAST(ceil(log2(count(value))) + 1 AS INT) AS k FROM long GROUP BY metric),
        binned AS (SELECT metric, low, (high - low) / k AS w, CASE WHEN high > low THEN least(CAST(floor((value - low) / ((high - low) / k)) AS INT), k - 1) ELSE 0 END AS bin
          FROM long JOIN span USING (metric) WHERE value IS NOT NULL)
        SELECT metric, bin, round(max(low + bin * w), 6) AS bin_start, count(*) AS n FROM binned GROUP BY metric, bin""",
}
