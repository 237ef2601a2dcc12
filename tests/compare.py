"""Rows of two engines, made comparable."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if pd.api.types.is_scalar(value) and pd.isna(value):
        return None
    if hasattr(value, "year"):
        return str(value)[:10]
    if isinstance(value, (bool, str)):
        return str(value)
    if hasattr(value, "tolist") or isinstance(value, list):
        return str(list(value))
    try:
        return repr(round(float(value), 8) + 0.0)
    except (TypeError, ValueError):
        return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=str)


def duck(sf_dir, sql):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con.execute(sql).fetchdf()
