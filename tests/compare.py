"""Order-free comparison of a Spark result with a DuckDB result on the same tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value) -> str:
    if value is None or value != value:
        return "NULL"
    return repr(value)


def _bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str, show: int = 3) -> str | None:
    """None when equal, else a short description."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected_rows = result.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    actual = _bag(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    expected = _bag(names, expected_rows)
    if actual == expected:
        return None
    extra, lost = actual - expected, expected - actual
    return (
        f"{sum(actual.values())} vs {sum(expected.values())} rows; "
        f"only Spark {list(extra)[:show]}; only SQL {list(lost)[:show]}"
    )
