"""Compares a query with its SQL in DuckDB, without regard to order."""

from __future__ import annotations

import math

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>":
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)
