"""Side by side: a registered query and its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, bool):
        return str(value)
    return value


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(normal(r[k]) for k in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)) * 0 + str(x)) for x in r))


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    got = df.collect()
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    want = found.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(columns)}"
    a, b = sorted_rows(df.columns, got), sorted_rows(columns, want)
    if a != b:
        first = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"{name}: {len(a)} and {len(b)} rows, first difference {first}"
    return ""
