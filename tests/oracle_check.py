"""Run registered queries and their SQL equivalents side by side and compare every row.

    python tests/oracle_check.py [sf] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TESTDATA = Path("/root/testdata")
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
}


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("oracle-check")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sf_dir.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, 0)
    if isinstance(v, (int, float)):
        v = round(float(v), 6)
        return (1, 0.0 if v == 0 else v)
    return (2, str(v))


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in records)


def compare(df, con, sql: str) -> str:
    """'' when schema and rows agree, else what differs."""
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want_types = {d[0]: str(d[1]) for d in rel.description}
    want = rows_of(rel.fetchall(), want_cols)
    got = rows_of(df.collect(), df.columns)
    notes = []
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    bad = {c: (t, want_types[c]) for c, t in df.dtypes if TYPES.get(want_types[c], want_types[c]) != t}
    if bad:
        notes.append(f"types {bad}")
    if len(got) != len(want):
        notes.append(f"rows {len(got)} != {len(want)}")
    elif got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w]
        notes.append(f"{len(diff)} rows differ, first {diff[0]} in order {sorted(df.columns)}")
    return "; ".join(notes)


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.01"
    sf_dir = TESTDATA / f"sf{sf}"
    spark, con = session(), connect(sf_dir)
    oracle, queries = entry.oracle_sql(), entry.queries()
    failed = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, str(sf_dir))
            note = compare(df, con, oracle[name]) if name in oracle else f"rows only: {len(df.collect())}"
            ok = not note or note.startswith("rows only")
        except Exception as e:  # report and go on with the next query
            note, ok = f"{type(e).__name__}: {str(e)[:600]}", False
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
