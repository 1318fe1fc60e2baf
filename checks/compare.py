"""Run every query on Spark and its statement on DuckDB, and compare the rows.

    python -m checks.compare [sf_dir] [key ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

from .queries import QUERIES
from .views import Views


def _cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def _rows(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("\x1f".join(_cell(row[i]) for i in order) for row in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def check(spark, con, sf_dir: str, key: str) -> tuple[str, float, int, str]:
    """``(verdict, seconds on Spark, rows, detail)``."""
    fn, sql = QUERIES[key]
    start = time.time()
    df = fn(Views(spark, sf_dir))
    got = df.collect()
    seconds = time.time() - start
    if sql is None:
        return ("rows" if got else "EMPTY"), seconds, len(got), ""
    relation = con.sql(sql)
    columns, wanted = relation.columns, relation.fetchall()
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", seconds, len(got), f"{sorted(df.columns)} != {sorted(columns)}"
    mine, theirs = _rows(df.columns, got), _rows(columns, wanted)
    if mine == theirs:
        return "ok", seconds, len(got), hashlib.md5("\n".join(mine).encode()).hexdigest()[:8]
    diff = next(((a, b) for a, b in zip(mine, theirs) if a != b), ("", ""))
    return "DIFF", seconds, len(got), f"{len(got)} vs {len(wanted)} rows\n  spark: {_around(diff[0], diff[1])!r}\n  duck:  {_around(diff[1], diff[0])!r}"


def _around(a: str, b: str) -> str:
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[max(0, at - 150) : at + 200]


def main() -> int:
    from bench import session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    keys = args[1:] or list(QUERIES)
    spark, con = session(), connect(sf_dir)
    bad = 0
    for key in keys:
        try:
            verdict, seconds, rows, detail = check(spark, con, sf_dir, key)
        except Exception as error:  # report every key
            verdict, seconds, rows, detail = "ERROR", 0.0, 0, str(error)[:1500]
        bad += verdict not in ("ok", "rows")
        print(f"{verdict:8} {seconds:6.1f}s {rows:7} {key} {detail}", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} fine")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
