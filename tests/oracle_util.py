"""Run a registered query on Spark and its oracle SQL on DuckDB; compare as multisets."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        v = round(v, 6) + 0.0
        return f"{v:.6f}"
    if isinstance(v, (dt.datetime,)):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        return _canon(v.item())
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_canon(rec[i]) for i in order) for rec in records), [columns[i] for i in order]


def compare(spark_df, sql: str, con):
    s_cols = spark_df.columns
    s_rows, s_names = rows_of(s_cols, [tuple(r) for r in spark_df.collect()])
    res = con.execute(sql)
    o_cols = [d[0] for d in res.description]
    o_rows, o_names = rows_of(o_cols, res.fetchall())
    report = {"spark_rows": len(s_rows), "oracle_rows": len(o_rows), "columns_match": s_names == o_names}
    if s_names != o_names:
        report["spark_cols"], report["oracle_cols"] = s_names, o_names
    a, b = set(s_rows), set(o_rows)
    report["only_spark"] = sorted(a - b)[:5]
    report["only_oracle"] = sorted(b - a)[:5]
    report["match"] = report["columns_match"] and s_rows == o_rows
    return report
