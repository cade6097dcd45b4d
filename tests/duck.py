"""Row-for-row comparison with SQL run on the same files."""

from __future__ import annotations

import datetime as dt
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def plain(value):
    """Value with its kind, so that 1, 1.0 and '1' differ."""
    if isinstance(value, bool):
        return "bool", value
    if isinstance(value, float):
        return "float", repr(value)
    if isinstance(value, decimal.Decimal):
        return "decimal", str(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return type(value).__name__, value.isoformat()
    return type(value).__name__, str(value)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())


def sql_rows(connection, sql):
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    return columns, sorted(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
