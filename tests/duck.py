"""DuckDB beside Spark: the same rows, whatever their order."""

import glob
import math
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


def from_duck(c: duckdb.DuckDBPyConnection, sql: str):
    found = c.execute(sql)
    return rows_of([d[0] for d in found.description], found.fetchall())


def from_spark(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
