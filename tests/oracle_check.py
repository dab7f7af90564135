"""Local twin of the driver's correctness gate.

Runs a registered Spark query and its DuckDB oracle over the same parquet
tables and compares row count, column names and an order-insensitive hash
of the values (columns sorted by name first).
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), digits) + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    return v


def canon(columns: list[str], rows: list[tuple], digits: int = 6):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted((tuple(_norm(r[i], digits) for i in order) for r in rows), key=repr)
    h = hashlib.sha256(repr(out).encode()).hexdigest()
    return cols, out, h


def spark_rows(df):
    cols = df.columns
    rows = [tuple(r[c] for c in cols) for r in (x.asDict(recursive=True) for x in df.collect())]
    return cols, rows


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(spark_df, con, sql: str, digits: int = int(os.environ.get("ORACLE_DIGITS", "6"))) -> dict:
    sc, sr = spark_rows(spark_df)
    dc, dr = duck_rows(con, sql)
    scols, srows, sh = canon(sc, sr, digits)
    dcols, drows, dh = canon(dc, dr, digits)
    res = {"rows_spark": len(srows), "rows_oracle": len(drows),
           "cols_match": scols == dcols, "hash_match": sh == dh}
    if scols != dcols:
        res["cols"] = (scols, dcols)
    elif sh != dh:
        dset, sset = set(drows), set(srows)
        only_s = [r for r in srows if r not in dset][:3]
        only_d = [r for r in drows if r not in sset][:3]
        res["diff"] = {"spark_only": only_s, "oracle_only": only_d}
    res["ok"] = res["cols_match"] and res["hash_match"] and len(srows) == len(drows)
    return res
