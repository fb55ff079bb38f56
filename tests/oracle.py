"""Compares a query's rows with those of its SQL on DuckDB."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def value(x):
    if x is None or x != x:
        return None
    return round(float(x), 6) if isinstance(x, float) else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(value(r[i]) for i in order)) for r in found)


def same(df, con, sql):
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())
