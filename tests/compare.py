"""Helpers to run oracle SQL in DuckDB and compare with a Spark result."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
_CON: dict[str, duckdb.DuckDBPyConnection] = {}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    if sf_dir not in _CON:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        _CON[sf_dir] = con
    return _CON[sf_dir]


def run_sql(sf_dir: str, sql: str) -> pd.DataFrame:
    return duck(sf_dir).execute(sql).df()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(None if (not isinstance(v, (list, tuple, dict)) and pd.isna(v)) else v) for v in rec))
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in t))


def diff(spark_df, oracle_pdf: pd.DataFrame, limit: int = 5) -> str | None:
    """None if equal as multisets of rows (columns matched by name), else a message."""
    s = spark_df.toPandas()
    if sorted(s.columns) != sorted(oracle_pdf.columns):
        return f"columns differ: spark={sorted(s.columns)} oracle={sorted(oracle_pdf.columns)}"
    a, b = rows_of(s), rows_of(oracle_pdf)
    if len(a) != len(b):
        sa, sb = set(a), set(b)
        return f"row count spark={len(a)} oracle={len(b)}; only spark: {list(sa - sb)[:limit]} only oracle: {list(sb - sa)[:limit]}"
    if a != b:
        sa, sb = set(a), set(b)
        return f"values differ; only spark: {list(sa - sb)[:limit]} only oracle: {list(sb - sa)[:limit]}"
    return None
