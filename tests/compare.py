"""Run registered queries next to their DuckDB statements and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
import traceback
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, Decimal)):
        return type(value).__name__
    if isinstance(value, dt.datetime):
        return "datetime"
    return type(value).__name__


def norm(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def compare(spark: SparkSession, folder: str, fn, sql: str | None) -> tuple[bool, str]:
    started = time.time()
    df = fn(spark, folder)
    cols = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return bool(rows), f"rows-only {len(rows)} rows {took:.1f}s"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in at) for r in cur.fetchall()]
    if len(rows) != len(want):
        return False, f"{len(rows)} rows vs {len(want)}"
    kinds = lambda rs: [{kind(r[i]) for r in rs} - {"null"} for i in range(len(cols))]
    if kinds(rows) != kinds(want):
        return False, f"types {dict(zip(cols, zip(kinds(rows), kinds(want))))}"
    key = lambda r: tuple(repr(v) for v in r)
    a, b = sorted(rows, key=key), sorted(want, key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} rows differ, first {bad[0]} (columns {cols})"
    return True, f"{len(rows)} rows {took:.1f}s" + (" EMPTY" if not rows else "")


def main() -> int:
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from tapeloom.session import get_session

    folder = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("sf"):
        folder = f"/root/testdata/{args.pop(0)}"
    spark = get_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    oracles = oracle_sql()
    for name, fn in queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            ok, note = compare(spark, folder, fn, oracles.get(name))
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:700]}"
            if "-v" in args:
                traceback.print_exc()
        failed += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(min(main(), 1))
