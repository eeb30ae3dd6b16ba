"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

    python tests/oracle_check.py 0.01 [query ...]

Order-free comparison of rows (columns sorted by name, floats rounded to 6).
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def rows_of(cols, rows):
    order = sorted(cols)
    idx = [cols.index(c) for c in order]
    return sorted((tuple(norm(r[i]) for i in idx) for r in rows), key=repr)


def check(spark, name: str, fn, sql: str | None, sf_dir: str, con=None, verbose=True):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = df.collect()
    ts = time.time() - t0
    S = rows_of(df.columns, srows)
    if sql is None:
        if verbose:
            print(f"{name:24s} spark {len(S):7d} rows {ts:6.1f}s | no oracle (rows only)")
        return True, len(S)
    con = con or duck(sf_dir)
    t0 = time.time()
    rel = con.sql(sql)
    dcols, drows = rel.columns, rel.fetchall()
    td = time.time() - t0
    ok_cols = sorted(df.columns) == sorted(dcols)
    D = rows_of(dcols, drows) if ok_cols else []
    same = ok_cols and S == D
    if verbose:
        print(f"{name:24s} spark {len(S):7d} rows {ts:6.1f}s | duck {len(drows):7d} rows {td:5.1f}s | "
              f"{'MATCH' if same else 'DIFF'}", flush=True)
        if not ok_cols:
            print("   spark cols", df.columns, "\n   duck cols ", dcols)
        elif not same:
            ds, ss = set(D), set(S)
            print("   only spark:", [r for r in S if r not in ds][:3])
            print("   only duck :", [r for r in D if r not in ss][:3])
    return same, len(S)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "0.01"
    sf_dir = sf if sf.startswith("/") else f"/root/testdata/sf{sf}"
    import __spark_entry__ as E
    from captionflow.session import get_spark
    spark = get_spark("local[8]", 8, extra={"spark.ui.showConsoleProgress": "false"})
    qs, sq = E.queries(), E.oracle_sql()
    names = argv[2:] or list(qs)
    con = duck(sf_dir)
    bad = []
    for n in names:
        try:
            ok, _ = check(spark, n, qs[n], sq.get(n), sf_dir, con)
        except Exception as e:  # report and go on
            print(f"{n:24s} ERROR {type(e).__name__}: {str(e)[:300]}")
            ok = False
        if not ok:
            bad.append(n)
    print("FAILED:", bad if bad else "none", f"({len(names) - len(bad)}/{len(names)} ok)")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
