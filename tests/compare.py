"""Row-exact comparison of a registered query with its SQL on DuckDB."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str, show: int = 4) -> list[str]:
    cursor = con.execute(sql)
    expected_columns, expected = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    columns, actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if columns != expected_columns:
        return [f"columns {set(columns) ^ set(expected_columns)}"]
    if len(actual) != len(expected):
        problems.append(f"rows {len(actual)} vs {len(expected)}")
    if actual != expected:
        left, right = set(map(repr, actual)), set(map(repr, expected))
        problems.append(f"only spark {sorted(left - right)[:show]}")
        problems.append(f"only sql {sorted(right - left)[:show]}")
        problems.append(f"counts {len(left - right)} / {len(right - left)} of {len(actual)}; columns {columns}")
    return problems
