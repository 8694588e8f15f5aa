"""Compares queries with their SQL in DuckDB, by columns in the order of their names."""

from __future__ import annotations

import os

import duckdb
import numpy as np


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def plain(x):
    return None if x is None or (isinstance(x, float) and np.isnan(x)) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def compare(spark, sf_dir: str, query, sql: str) -> int:
    df = query(spark, sf_dir)
    found = tables(sf_dir).execute(sql)
    want = rows([c[0] for c in found.description], found.fetchall())
    got = rows(df.columns, df.collect())
    assert got == want, (got[0], want[0], len(got[1]), len(want[1]), [x for x in got[1] if x not in want[1]][:5], [x for x in want[1] if x not in got[1]][:5])
    return len(got[1])
