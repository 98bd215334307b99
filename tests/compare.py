"""Differential check of queries() against oracle_sql() on DuckDB.

Mirrors the driver: row count, column names, and an order-insensitive hash of
the values (columns sorted by name, floats rounded).

    python tests/compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from codeloom.sources.tables import TABLES  # noqa: E402


def _norm(v, nd=int(__import__("os").environ.get("COMPARE_DECIMALS", "4"))):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, nd)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, nd) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, nd)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True), nd)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr), [cols[i] for i in order]


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv[1:] if not a.startswith("/")]
    import os
    if os.environ.get("COMPARE_PLAIN_SESSION"):
        # a session as a driver would build it: no tuning, default shuffle partitions
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        from codeloom.session import build_session
        spark = build_session("local[8]")
    con = duck(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for k in keys or list(qs):
        t0 = time.time()
        sdf = qs[k](spark, sf_dir)
        srows = [tuple(r) for r in sdf.collect()]
        ts = time.time() - t0
        if k not in orc:
            print(f"{k:28s} rows={len(srows):7d} spark={ts:6.1f}s  (no oracle)")
            continue
        t0 = time.time()
        res = con.execute(orc[k])
        dcols = [d[0] for d in res.description]
        drows = res.fetchall()
        td = time.time() - t0
        a, ac = rows_of(sdf.columns, srows)
        b, bc = rows_of(dcols, drows)
        ok = (ac == bc) and len(a) == len(b) and a == b
        bad += not ok
        print(f"{k:28s} rows={len(srows):7d}/{len(drows):7d} spark={ts:6.1f}s duck={td:5.1f}s {'OK' if ok else 'MISMATCH'}")
        if not ok:
            if ac != bc:
                print("   cols", ac, bc)
            sa, sb = set(a), set(b)
            print("   only spark:", list(sa - sb)[:3])
            print("   only duck :", list(sb - sa)[:3])
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
