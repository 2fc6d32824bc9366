"""Runs a query and its SQL side by side."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or hasattr(value, "quantize"):
        return round(float(value), 5) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(row[i])) for i in order) for row in rows)


def difference(spark, con, query, sql, sf_dir):
    """None if both give the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    relation = con.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return sorted(df.columns), sorted(relation.columns)
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(relation.columns, relation.fetchall())
    if mine == theirs:
        return None
    return [x for x in mine if x not in set(theirs)][:3], [x for x in theirs if x not in set(mine)][:3], len(mine), len(theirs)
