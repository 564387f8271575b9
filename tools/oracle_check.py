"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tools/oracle_check.py [--sf DIR] [name ...]

Columns are compared by name (sorted), rows as multisets. A value match is
reported exact, or within 1e-9 relative for floats.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tarmac.sources.tables import TABLES  # noqa: E402


def norm(v, tol: bool):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if tol:
            return float(f"{v:.9g}")
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, tol) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x, tol)) for k, x in v.items()))
    return v


def rows_key(cols, rows, tol):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i], tol) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--conf", action="append", default=[], help="extra Spark conf key=value")
    ap.add_argument("--oracle-only", action="store_true", help="only queries with oracle SQL")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()

    from tarmac.plans import ORACLE, QUERIES, load_all
    from tarmac.session import get_spark
    load_all()
    extra = dict(kv.split("=", 1) for kv in a.conf)
    spark = get_spark("local[8]", 8, extra=extra)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    names = a.names or [n for n in QUERIES if not a.oracle_only or n in ORACLE]
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, a.sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in ORACLE:
            print(f"{name:32s} rows={len(srows):6d} (no oracle) {ts:.2f}s")
            continue
        try:
            res = con.execute(ORACLE[name])
            drows = res.fetchall()
            dcols = [c[0] for c in res.description]
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SQL-ERROR {str(e)[:300]}")
            bad += 1
            continue
        same_cols = sorted(scols) == sorted(dcols)
        exact = same_cols and rows_key(scols, srows, False) == rows_key(dcols, drows, False)
        close = same_cols and rows_key(scols, srows, True) == rows_key(dcols, drows, True)
        status = "OK" if exact else ("CLOSE" if close else "DIFF")
        if status == "DIFF":
            bad += 1
        print(f"{name:32s} {status:5s} rows spark={len(srows)} sql={len(drows)} cols_match={same_cols} {ts:.2f}s")
        if status == "DIFF":
            if not same_cols:
                print("   spark cols", sorted(scols), "\n   sql cols  ", sorted(dcols))
            else:
                a_ = rows_key(scols, srows, True)
                b_ = rows_key(dcols, drows, True)
                diff_a = [r for r in a_ if r not in b_][:3]
                diff_b = [r for r in b_ if r not in a_][:3]
                print("   spark-only", diff_a, "\n   sql-only  ", diff_b)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
