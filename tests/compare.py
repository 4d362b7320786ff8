"""Run a registered query and its SQL twin and compare whole results."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


def _value(value: object) -> object:
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return ("double", repr(value))
    return (type(value).__name__, value)


def rows_of(names: list[str], rows: list) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    ours = spark_df.collect()
    cursor = con.execute(sql)
    names, theirs = [c[0] for c in cursor.description], cursor.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    left, right = rows_of(spark_df.columns, ours), rows_of(names, theirs)
    notes = [f"rows {len(ours)} != {len(theirs)}"] if len(ours) != len(theirs) else []
    only_left, only_right = left - right, right - left
    if only_left or only_right:
        notes.append(f"{sum(only_left.values())} rows differ")
        notes += [f"spark {row}" for row in sorted(only_left, key=str)[:2]]
        notes += [f"sql   {row}" for row in sorted(only_right, key=str)[:2]]
    return notes
