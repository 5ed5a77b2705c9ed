"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, dict):
        return tuple(map(plain, value.values()))
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def connect(folder):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def compare(spark, folder, con, query, sql):
    df = query(spark, folder)
    columns = sorted(df.columns)
    left = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = con.sql(sql)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    right = sorted(repr(tuple(plain(row[i]) for i in at)) for row in result.fetchall())
    assert left == right
