"""Spark-vs-DuckDB result comparison (row count, column names, order-insensitive values)."""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


STRICT = os.environ.get("COMPARE_STRICT") == "1"  # exact float bits instead of 6 decimals


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (decimal.Decimal, float)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return repr(f) if STRICT else round(f, 6)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (_dt.date, _dt.datetime)):
        return v.isoformat()
    return str(v)


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    return cols, out


def compare(spark_df, con, sql: str) -> dict:
    s_rows = [tuple(r) for r in spark_df.collect()]
    s_cols = spark_df.columns
    res = con.execute(sql)
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    sc, sr = canonical(s_cols, s_rows)
    oc, orows = canonical(o_cols, o_rows)
    return {
        "rows_spark": len(sr), "rows_oracle": len(orows),
        "columns_match": sc == oc, "values_match": sr == orows,
        "spark_columns": sc, "oracle_columns": oc,
        "diff_example": next(((a, b) for a, b in zip(sr, orows) if a != b), None),
    }
