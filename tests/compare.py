"""Run a registered query and its SQL twin, and compare whole results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def differences(spark, connection, function, sql, sf_dir):
    """Empty if equal, else a short text."""
    frame = function(spark, sf_dir)
    cursor = connection.execute(sql)
    sql_columns = [item[0] for item in cursor.description]
    sql_rows = cursor.fetchall()
    if sorted(frame.columns) != sorted(sql_columns):
        return f"columns {sorted(frame.columns)} / {sorted(sql_columns)}"
    ours = rows_of(frame.columns, frame.collect())
    theirs = rows_of(sql_columns, sql_rows)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    off = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(off)} of {len(ours)} rows differ, first {off[0]}" if off else ""
