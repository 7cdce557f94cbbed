"""Comparing a query's rows with its oracle's, as the driver does: by column name, in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool) or v is None:
        return v
    return float(v) if isinstance(v, int) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    wanted = rows(names, found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} are not {sorted(names)}"
    if got != wanted:
        first = next(((a, b) for a, b in zip(got, wanted, strict=False) if a != b), None)
        return f"{len(got)} and {len(wanted)} rows; first difference {first}"
    return ""
