"""Run the registered queries next to their SQL twins: `python tests/check_queries.py [sf] [names]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = "/root/testdata"


def connect(sf_dir: str):
    from catalog.base import TABLES
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, float, int]:
    """('ok' | what differs, Spark seconds, rows)."""
    from catalog import QUERIES, SQL
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    seconds = time.time() - started
    if name not in SQL:
        return "no SQL twin", seconds, len(rows)
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    twin = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(columns)}", seconds, len(rows)
    ours, theirs = canonical(df.columns, rows), canonical(columns, twin)
    if ours == theirs:
        return "ok" if rows else "ok, but empty", seconds, len(rows)
    differing = [(a, b) for a, b in zip(ours, theirs) if a != b][:2]
    return f"{len(ours)} rows <> {len(theirs)}; sorted {sorted(columns)}: {differing}", seconds, len(rows)


def main() -> int:
    from catalog import QUERIES
    from riskframe.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{TESTDATA}/sf{sf}"
    con, bad = connect(sf_dir), 0
    for name in names:
        try:
            verdict, seconds, n = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            verdict, seconds, n = f"{type(e).__name__}: {str(e)[:700]}", 0.0, 0
        bad += verdict != "ok"
        print(f"{'' if verdict == 'ok' else 'BAD '}{name} {n} rows {seconds:.1f}s {'' if verdict == 'ok' else verdict[:1500]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
