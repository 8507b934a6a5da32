"""Compare a registered query with its SQL: same rows in any order."""

from __future__ import annotations

import math
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return rows_of(df.columns, df.collect())


def duck_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return rows_of(columns, cursor.fetchall())


def difference(query, sql, spark, con, sf):
    """None when equal, else a short text of what differs."""
    columns, got = spark_rows(query(spark, sf))
    expected_columns, expected = duck_rows(con, sql)
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if got != expected:
        missing, extra = expected - got, got - expected
        return (
            f"rows {sum(got.values())} vs {sum(expected.values())}; "
            f"missing {list(missing.items())[:3]}; extra {list(extra.items())[:3]}"
        )
    return None
