"""Runs a registered query and its SQL oracle and compares rows, columns and values."""

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    return repr(value)


def keyed(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return keyed(df.columns, [tuple(row) for row in df.collect()])


def duck_rows(connection, sql):
    result = connection.execute(sql)
    return keyed([item[0] for item in result.description], result.fetchall())


def difference(spark, sf_dir, name, query, sql, connection):
    """Empty when equal, else a description of the first difference; and both times."""
    start = time.time()
    columns, rows = spark_rows(query(spark, sf_dir))
    middle = time.time()
    wanted_columns, wanted = duck_rows(connection, sql)
    times = (middle - start, time.time() - middle)
    if columns != wanted_columns:
        return f"{name}: columns {columns} vs {wanted_columns}", times, len(rows)
    if len(rows) != len(wanted):
        return f"{name}: {len(rows)} rows vs {len(wanted)}", times, len(rows)
    for ours, theirs in zip(rows, wanted):
        if ours != theirs:
            bad = sum(1 for a, b in zip(rows, wanted) if a != b)
            return f"{name}: {bad} rows differ, first {ours} vs {theirs}", times, len(rows)
    return "", times, len(rows)
