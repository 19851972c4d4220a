"""Run catalogue queries in Spark and their oracle SQL in DuckDB and compare.

Mirrors the driver's check: same column names, same row count, and the same
multiset of rows after sorting columns by name. Usage:

    python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from modlens.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return ("~null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("~nan",)
        if v == int(v) and abs(v) < 1e15:
            return int(v)
        return round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            problems.append(f"values differ, e.g. {diff}")
    return problems, len(s_rows), t1 - t0


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    from __spark_entry__ import oracle_sql, queries
    from modlens.session import build_session

    spark = build_session()
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for key in sorted(qs):
        if only and key not in only:
            continue
        if key not in sqls:
            df = qs[key](spark, sf_dir)
            print(f"ROWS-ONLY {key}: {df.count()} rows", flush=True)
            continue
        try:
            problems, n, secs = compare(spark, con, key, qs[key], sqls[key], sf_dir)
        except Exception as e:  # report and go on
            problems, n, secs = [f"error {type(e).__name__}: {str(e)[:400]}"], -1, 0
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{status} {key}: {n} rows {secs:.1f}s {' | '.join(problems)}", flush=True)
    print(f"{bad} mismatching")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
