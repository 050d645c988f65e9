"""Compare registered queries with their SQL in DuckDB: python check_queries.py [--sf DIR] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from trackspark.plans.catalog import load
from trackspark.plans.views import TABLES, Views
from trackspark.session import local_session


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        values = []
        for i in order:
            value = row[i]
            if isinstance(value, float):
                value = None if math.isnan(value) else value + 0.0
            values.append((type(value).__name__, repr(value)))
        out.append(tuple(values))
    return sorted(out), [columns[i] for i in order]


def main(argv):
    sf = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        sf, argv = argv[1], argv[2:]
    registry = load()
    names = [n for n in registry if not argv or any(n == a or n.startswith(a + "_") or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    spark = local_session("check")
    views = Views(spark, sf)
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    bad = []
    for name in names:
        fn, sql = registry[name]
        try:
            t = time.time()
            df = fn(views)
            rows = [tuple(r) for r in df.collect()]
            spent = time.time() - t
            if sql is None:
                print(f"rows {name} {len(rows)} {spent:.1f}s", flush=True)
                if not rows:
                    bad.append(name)
                continue
            cur = con.execute(sql)
            want = cur.fetchall()
            a, ca = canonical(rows, df.columns)
            b, cb = canonical(want, [d[0] for d in cur.description])
            ok = a == b and ca == cb and rows
            print(f"{'ok  ' if ok else 'BAD '} {name} {len(rows)}/{len(want)} {spent:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                print("   cols", ca, cb)
                sa, sb = set(a), set(b)
                print("   spark only", sorted(sa - sb)[:3])
                print("   sql only  ", sorted(sb - sa)[:3])
        except Exception as error:
            bad.append(name)
            print(f"ERR  {name} {type(error).__name__}: {str(error)[:1200]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
