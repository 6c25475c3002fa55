"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple(_plain(row[i]) for i in order) for row in rows
    )


def differences(spark, con, query, sql, sf_dir) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    spark_columns, spark_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    sql_columns, sql_rows = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if spark_columns != sql_columns:
        return f"columns {spark_columns} against {sql_columns}"
    if spark_rows != sql_rows:
        only_spark, only_sql = spark_rows - sql_rows, sql_rows - spark_rows
        return (
            f"{spark_rows.total()} rows against {sql_rows.total()}; "
            f"only Spark {list(only_spark)[:3]}; only SQL {list(only_sql)[:3]}"
        )
    return None
