"""Compare a registered query with its SQL counterpart, order-insensitively and by column name."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


SAME = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def differences(df, con, sql: str) -> str:
    """Empty when equal; otherwise a short description."""
    rel = con.sql(sql)
    names, types = rel.columns, [str(t) for t in rel.types]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    kinds = dict(df.dtypes)
    off = [(n, kinds[n], t) for n, t in zip(names, types) if SAME.get(kinds[n], kinds[n]) != t]
    got, want = _rows(df.collect(), df.columns), _rows(rel.fetchall(), names)
    note = f"types {off}; " if off else ""
    if got == want:
        return note
    a, b = set(got), set(want)
    return note + f"rows {len(got)} <> {len(want)}; spark only {list(a - b)[:3]}; sql only {list(b - a)[:3]}"
