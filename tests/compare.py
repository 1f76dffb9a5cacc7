"""Run a registered query in Spark and its SQL in DuckDB and compare them row by row."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, fn, statement):
    """(equal, number of rows, message)."""
    df = fn(spark, folder)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(statement)
    want_names, want = rows_of([d[0] for d in result.description], result.fetchall())
    n = sum(want.values())
    if got_names != want_names:
        return False, n, f"columns {got_names} != {want_names}"
    if got != want:
        extra, missing = got - want, want - got
        return False, n, (
            f"spark {sum(got.values())} rows, sql {n}; "
            f"only spark {sum(extra.values())}: {str(list(extra.items())[:2])[:600]}; "
            f"only sql {sum(missing.values())}: {str(list(missing.items())[:2])[:600]}"
        )
    return True, n, ""
