"""Runs catalogue queries on Spark and their SQL on DuckDB and compares rows without regard to order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

from loomgraph.plans.derived import TABLES


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def oracle(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def compare(spark, con, sf_dir: str, f, sql: str) -> str:
    """Empty if both agree, else what differs."""
    got = f(spark, sf_dir)
    rel = con.sql(sql)
    if sorted(got.columns) != sorted(rel.columns):
        return f"columns {sorted(got.columns)} and {sorted(rel.columns)}"
    a, b = rows(got.columns, got.collect()), rows(rel.columns, rel.fetchall())
    if a == b:
        return ""
    x, y = [r for r in a if r not in b][:3] if len(a) < 5000 else a[:2], [r for r in b if r not in a][:3] if len(b) < 5000 else b[:2]
    return f"{len(a)} and {len(b)} rows; {x} and {y}"
