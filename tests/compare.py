"""Comparison of a Spark query with its SQL in DuckDB, rows without order, doubles to nine digits."""

import glob
import os

import duckdb


def connection(sf_dir):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(map(plain, r)) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)


def same(df, sql, c):
    names, got = rows_of(df)
    answer = c.sql(sql)
    columns = answer.columns
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in answer.fetchall()), key=repr)
    assert got == want
    return len(got)
