"""Run registered queries against their DuckDB SQL and report differences.

usage: check_queries.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wavelane import oracles, registry  # noqa: E402
from wavelane.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(plain(r[k])) for k in order) for r in data)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = registry.queries(), oracles.oracle_sql()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            got = rows(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if name not in sql:
                print(f"{name:28s} no sql  {len(got):8d} rows {took:6.1f}s", flush=True)
                continue
            start = time.time()
            rel = db.sql(sql[name])
            want = rows(rel.columns, rel.fetchall())
            names_ok = sorted(df.columns) == sorted(rel.columns)
            ok = names_ok and got == want
            bad += not ok
            print(
                f"{name:28s} {'ok' if ok else 'DIFF':6s} {len(got):8d} / {len(want)} rows "
                f"{took:6.1f}s sql {time.time() - start:5.1f}s", flush=True,
            )
            if not ok:
                print("   columns", sorted(df.columns), sorted(rel.columns))
                only = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
                print("   spark only", only[0], "\n   sql only  ", only[1])
        except Exception as error:
            bad += 1
            print(f"{name:28s} ERROR {type(error).__name__} {str(error)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
