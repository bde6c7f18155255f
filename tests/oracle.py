"""Runs a query and its SQL over the same tables and compares their rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    if isinstance(x, bool):
        return x
    if isinstance(x, int | float):
        return round(float(x), 8) + 0.0
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def connection(sf_dir: str = SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def same(spark, query, sql: str, sf_dir: str = SF) -> None:
    df = query(spark, sf_dir)
    found = connection(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())
