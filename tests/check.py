"""Compare named queries with their check SQL: ``python tests/check.py [sf] [name part ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, folder, fn, sql):
    """Return None when equal, else a short description of the difference."""
    df = fn(spark, folder)
    mine_cols, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine_cols != cols:
        return f"columns {mine_cols} vs {cols}"
    if len(mine) != len(theirs):
        extra = list(set(mine) - set(theirs))[:2]
        miss = list(set(theirs) - set(mine))[:2]
        return f"rows {len(mine)} vs {len(theirs)}\n   spark only {extra}\n   check only {miss}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"{len(bad)}/{len(mine)} rows differ in {cols}: {bad[0][0]} vs {bad[0][1]}"
    if not mine:
        return "no rows"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from chartmill.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0].isdigit() else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(folder)
    checks = oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            if name in checks:
                why = compare(spark, con, folder, fn, checks[name])
            else:
                why = None if fn(spark, folder).count() else "no rows"
        except Exception as exc:  # report and go on
            why = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += why is not None
        print(f"{'FAIL' if why else 'ok  '} {name} {time.time() - start:.1f}s {why or ''}", flush=True)
    print("failed", failed)
