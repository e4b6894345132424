"""Side-by-side check of a registered query against its DuckDB oracle.

Mirrors the driver's gate: row count, column names, and an order-insensitive
comparison of values (floats compared after rounding to 6 digits).
"""

from __future__ import annotations

import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_frame(sql: str, sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).fetchdf()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and not isinstance(v, str)):
        return tuple(_norm(x) for x in (v.tolist() if hasattr(v, "tolist") else v))
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_df, sql: str, sf_dir: str) -> dict:
    import pandas as pd
    sp = spark_df.toPandas()
    dk = duckdb_frame(sql, sf_dir)
    sp = sp.astype(object).where(pd.notna(sp), None)
    dk = dk.astype(object).where(pd.notna(dk), None)
    sc, sr = _rows(sp)
    dc, dr = _rows(dk)
    res = {"rows_spark": len(sr), "rows_oracle": len(dr), "columns_match": sc == dc,
           "spark_columns": sc, "oracle_columns": dc}
    res["values_match"] = res["columns_match"] and sr == dr
    if not res["values_match"] and res["columns_match"]:
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        res["first_diffs"] = diff
    return res
