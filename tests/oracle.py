"""Compares a query's rows with its SQL twin's."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def rows_of(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)

    def plain(v):
        if v is None or (not isinstance(v, (str, list)) and pd.isna(v)):
            return ""
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0) if v % 1 else str(int(v))
        return str(v)

    return names, sorted(tuple(plain(v) for v in row) for row in df[names].itertuples(index=False))
