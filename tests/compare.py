"""Row-set comparison of a Spark query with its DuckDB SQL."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or value != value:
        return None
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(
        (tuple(_plain(row[n]) for n in names) for row in df.collect()), key=repr
    )


def duck_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    order = [columns.index(n) for n in sorted(columns)]
    rows = [tuple(_plain(row[i]) for i in order) for row in result.fetchall()]
    return sorted(columns), sorted(rows, key=repr)
