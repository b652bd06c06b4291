"""Runs a registered query and its SQL and compares the rows, whatever their order."""

from __future__ import annotations

import os

import duckdb


def plain(value):
    if value is None or isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "%.9g" % value
    if isinstance(value, int):
        return "%.9g" % value if abs(value) < 1e9 else str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def database(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{files}'")
    return con


def both(spark, folder, query, sql):
    made = query(spark, folder)
    cursor = database(folder).execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(made.columns) == sorted(columns)
    return rows_of(made.columns, [tuple(r) for r in made.collect()]), rows_of(columns, cursor.fetchall())
