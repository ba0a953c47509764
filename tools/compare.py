"""Run registered queries on Spark and their SQL oracles on DuckDB, compare.

Usage: python tools/compare.py SF_DIR [name,name,...]
Prints one line per query: match / mismatch with the first differences.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from delaymart.plans.oracle import oracle_sql  # noqa: E402
from delaymart.plans.queries import QUERIES  # noqa: E402
from delaymart.session import build_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if os.environ.get("EXACT") else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "item"):
        return v.item()
    return v


def key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0)
                 for x in row)


def main():
    sf = sys.argv[1]
    only = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sqls = oracle_sql()
    bad = 0
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            cols = df.columns
            srows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"SPARK-FAIL {name}: {type(e).__name__}: {str(e)[:600]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"rows-only {name}: {len(srows)} rows {ts:.2f}s")
            continue
        try:
            rel = con.execute(sqls[name])
            dcols = [d[0] for d in rel.description]
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"SQL-FAIL {name}: {type(e).__name__}: {str(e)[:600]}")
            bad += 1
            continue
        if sorted(c.lower() for c in cols) != sorted(c.lower() for c in dcols):
            print(f"COLS {name}: spark={sorted(cols)} sql={sorted(dcols)}")
            bad += 1
            continue
        order = sorted(cols, key=str.lower)
        si = [cols.index(c) for c in order]
        dl = [c.lower() for c in dcols]
        di = [dl.index(c.lower()) for c in order]
        a = sorted([tuple(r[i] for i in si) for r in srows], key=key)
        b = sorted([tuple(norm(r[i]) for i in di) for r in drows], key=key)
        if a == b:
            print(f"match {name}: {len(a)} rows {ts:.2f}s")
        else:
            bad += 1
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"MISMATCH {name}: spark {len(a)} rows, sql {len(b)} rows; cols {order}")
            for x, y in diff:
                print("   spark:", x)
                print("   sql  :", y)
    print("bad:", bad)


if __name__ == "__main__":
    main()
