"""Run registered queries and compare them with their SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from quillflow.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str, limit: int = 5) -> list[str]:
    frame = entry.queries()[name](spark, folder)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return [] if got else ["no rows"]
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    problems = []
    if sorted(columns) != sorted(frame.columns):
        problems.append(f"columns {sorted(frame.columns)} want {sorted(columns)}")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows, want {len(want)}")
    if got != want:
        extra = sorted(set(map(repr, got)) - set(map(repr, want)))[:limit]
        missing = sorted(set(map(repr, want)) - set(map(repr, got)))[:limit]
        problems.append(f"extra {extra}\n   missing {missing}")
    return problems


if __name__ == "__main__":
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(8, 8), duck(folder)
    names = sys.argv[1:] or list(entry.queries())
    failed = 0
    for name in names:
        start = time.time()
        try:
            problems = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s", *problems, sep="\n   "
              if problems else " ", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
