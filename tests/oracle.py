"""Compare a query with its DuckDB SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


def differences(df, con, sql: str) -> list:
    want = con.sql(sql)
    mine, theirs = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert sorted(df.columns) == sorted(want.columns)
    return [pair for pair in zip(mine, theirs, strict=False) if pair[0] != pair[1]][:3] + ([(len(mine), len(theirs))] if len(mine) != len(theirs) else [])
