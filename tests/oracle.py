"""Comparison of a query's rows with DuckDB's for its SQL."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def canonical(frame):
    def value(v):
        if v is None or v != v:
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v.item() if hasattr(v, "item") else v

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(value(v) for v in row) for row in frame.astype(object).itertuples(index=False)), key=repr)
