"""Comparing a DataFrame with SQL on the same tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float | Decimal):
        return "nan" if v != v else float(f"{float(v):.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows_of(rows, columns) -> list[tuple]:
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)


def same(df, sql: str, sf_dir: str) -> None:
    found = connect(sf_dir).sql(sql)
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert rows_of(df.collect(), columns) == want
