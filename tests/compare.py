"""Rows of a Spark query and of its DuckDB SQL, as comparable lists."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return bool(v) if type(v).__name__ == "bool_" else v.item() if hasattr(v, "item") else v


def rows_of(frame) -> list:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(_plain(v) for v in r) for r in frame.values.tolist()), key=repr)


def oracle(sql: str, sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db.sql(sql).df()
