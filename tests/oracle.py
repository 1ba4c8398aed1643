"""Runs a registered query and its DuckDB SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.01")


def connect(d: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(x):  # noqa: ANN001, ANN202
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    return x


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql: str) -> str:  # noqa: ANN001
    """Empty if the results agree, else what differs."""
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want, got = rows(names, cur.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    if want != got:
        extra, missing = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows; only here {extra}; only in SQL {missing}"
    return ""
