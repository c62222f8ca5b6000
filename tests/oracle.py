"""Comparing a query's rows with its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sf_dir: str, text: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(text).df()


def norm(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list):
            return str(x)
        if x is None or x is pd.NA or x != x:
            return "null"
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False))


def differs(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    g, w = norm(got), norm(want)
    if len(g) != len(w):
        return f"{len(g)} rows, {len(w)} expected"
    return next((f"{a} is not {b}" for a, b in zip(g, w) if a != b), "")
