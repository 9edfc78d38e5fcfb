"""Run catalogue queries next to their SQL in DuckDB and compare the results as multisets.

Usage: python tests/oracle_check.py [name-part ...]  (environment: SF_DIR; LARGE=1 takes the plans for
large inputs)
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def table_of(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple((type(plain(r[i])).__name__, plain(r[i])) for i in order) for r in rows
    )


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rows = df.collect()
    ours = table_of(df.columns, [tuple(r) for r in rows])
    con.execute(sql)
    theirs = table_of([d[0] for d in con.description], con.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        a = list((ours[1] - theirs[1]).elements())
        b = list((theirs[1] - ours[1]).elements())
        key = lambda r: str(r)
        return f"{len(rows)} rows, {len(a)} only in spark, {len(b)} only in sql\n    {sorted(a, key=key)[:3]}\n    {sorted(b, key=key)[:3]}"
    return None


def main(parts: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    from framewise.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    conf = {"spark.framewise.smallInputBytes": "0"} if os.environ.get("LARGE") else {}
    spark = local_session(os.environ.get("CPUS", "8"), **conf)
    con = connect(folder)
    bad = 0
    oracles = oracle_sql()
    for name, query in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        mark = "ok " if problem is None else "BAD"
        kind = "sql " if name in oracles else "rows"
        print(f"{mark} {kind} {name} {time.time() - start:.2f}s", flush=True)
        if problem:
            bad += 1
            print("   ", problem, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sys.exit(1 if main(sys.argv[1:]) else 0)
