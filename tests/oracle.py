"""Runs a query and its DuckDB twin and compares rows without order."""

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder=SF):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def text(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v.isoformat() if hasattr(v, "isoformat") else v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(text(v) for v in r) for r in df.itertuples(index=False))
