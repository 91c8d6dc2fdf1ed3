"""DuckDB equivalents of the imputation, neighbour, balancing and encoding queries."""

from __future__ import annotations

from panelwise.plans.oracle_views import TRAIN, TRAIN_MISSING, hash_uniform
from panelwise.plans.score_oracle import exact_mean
from panelwise.plans.train_queries import CATEGORICAL, NUMERIC


def drawn(column: str) -> str:
    u = hash_uniform(0, "seed", f"'{column}'", "g.row_id")
    return f"""pool_{column} AS (SELECT {column} AS v, row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) AS idx
        FROM gaps WHERE {column} IS NOT NULL),
      fill_{column} AS (SELECT imp, g.row_id, CAST(floor({u} * (SELECT count(*) FROM pool_{column})) + 1 AS BIGINT) AS idx
        FROM gaps g, runs WHERE g.{column} IS NULL),
      got_{column} AS (SELECT imp, row_id, v FROM fill_{column} JOIN pool_{column} USING (idx))"""


def imputed(columns: list[str], runs: int) -> str:
    joins = " ".join(f"LEFT JOIN got_{c} ON got_{c}.row_id = g.row_id AND got_{c}.imp = runs.imp" for c in columns)
    values = ", ".join(f"coalesce(g.{c}, got_{c}.v) AS {c}" for c in columns)
    return f"""WITH {TRAIN_MISSING}, runs AS (SELECT CAST(i AS INT) AS imp, 100 * i AS seed FROM range(1, {runs + 1}) r(i)),
      {', '.join(map(drawn, columns))}, imputed AS (SELECT runs.imp, g.row_id, {values}, g.y FROM gaps g CROSS JOIN runs {joins})"""


_TERMS = " + ".join(
    [f"((a.{c} / s.{c} - b.{c} / s.{c}) * (a.{c} / s.{c} - b.{c} / s.{c}))" for c in NUMERIC]
    + [f"CAST(a.{c} <> b.{c} AS INT)" for c in CATEGORICAL]
)
KNN = TRAIN + f""",
spans AS (SELECT {', '.join(f'max({c}) - min({c}) AS {c}' for c in NUMERIC)} FROM train WHERE y = 1),
pairs AS (SELECT a.row_id, b.row_id AS neighbour_id, {_TERMS} AS distance2
  FROM train a, train b, spans s WHERE a.y = 1 AND b.y = 1 AND a.row_id <> b.row_id),
knn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY distance2, neighbour_id) AS INT) AS rank
  FROM pairs) WHERE rank <= 5)"""


def u(*keys: str) -> str:
    return hash_uniform(1, *keys)


_NUM = ", ".join(f"round(a.{c} + {u('a.row_id', 'copy', chr(39) + 'g' + chr(39))} * (b.{c} - a.{c}), 6) AS {c}" for c in NUMERIC)
_CAT = ", ".join(f"CASE WHEN {u('a.row_id', 'copy', chr(39) + c + chr(39))} < 0.5 THEN a.{c} ELSE b.{c} END AS {c}" for c in CATEGORICAL)
_ASIS = ", ".join([f"round({c}, 6) AS {c}" for c in NUMERIC] + CATEGORICAL)
SMOTE = f"""WITH {KNN},
synthetic AS (SELECT a.row_id, copy, 'synthetic' AS kind, a.y, {_NUM}, {_CAT}
  FROM (SELECT row_id, CAST(i AS INT) AS copy, CAST(floor({u('row_id', 'i', "'n'")} * 5) + 1 AS INT) AS rank
        FROM train, range(1, 5) c(i) WHERE y = 1) plan
  JOIN knn USING (row_id, rank) JOIN train a ON a.row_id = plan.row_id JOIN train b ON b.row_id = neighbour_id),
pool AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) AS idx FROM train WHERE y = 0),
draws AS (SELECT CAST(i AS INT) AS copy,
    CAST(floor({u('row_id', 'i', "'m'")} * (SELECT count(*) FROM pool)) + 1 AS BIGINT) AS idx
  FROM train, range(1, 13) c(i) WHERE y = 1)
SELECT row_id, CAST(0 AS INT) AS copy, 'original' AS kind, y, {_ASIS} FROM train WHERE y = 1
UNION ALL SELECT * FROM synthetic
UNION ALL SELECT row_id, copy, 'common' AS kind, y, {_ASIS} FROM draws JOIN pool USING (idx)"""


def hot(column: str, levels: list[int]) -> str:
    return ", ".join(f'CAST(coalesce({column} = {v}, FALSE) AS DOUBLE) AS "{column}_{v}"' for v in levels)


ORACLE = {
    "sample_impute": imputed(["fa", "bmi", "education"], 1)
    + " SELECT imp, row_id, round(fa, 6) AS fa, round(bmi, 6) AS bmi, education, y FROM imputed",
    "stack_imputations": imputed(["fa", "bmi"], 10)
    + " SELECT imp, count(*) AS n, " + f"{exact_mean('fa')} AS mean_fa, {exact_mean('bmi')} AS mean_bmi FROM imputed GROUP BY imp",
    "minority_knn": f"WITH {KNN} SELECT row_id, rank, neighbour_id, round(distance2, 6) AS distance2 FROM knn",
    "smote": SMOTE,
    "one_hot": f"WITH {TRAIN} SELECT row_id, y, {hot('education', [1, 2, 3, 5, 98])}, {hot('stage', [1, 2, 3, 4])} FROM train",
}
