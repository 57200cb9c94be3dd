"""Run a query and its SQL twin over the same tables and compare whole results."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def differences(df, con, sql: str) -> list[str]:
    """Empty when columns, row count and every value agree."""
    found = con.execute(sql)
    theirs_columns = [d[0] for d in found.description]
    if sorted(df.columns) != sorted(theirs_columns):
        return [f"columns {sorted(df.columns)} / {sorted(theirs_columns)}"]
    ours = _sorted_rows(df.columns, df.collect())
    theirs = _sorted_rows(theirs_columns, found.fetchall())
    if len(ours) != len(theirs):
        return [f"rows {len(ours)} / {len(theirs)}"]
    kinds = {
        f"type of {c}: {type(a).__name__} / {type(b).__name__}"
        for x, y in zip(ours, theirs)
        for c, a, b in zip(sorted(df.columns), x, y)
        if type(a) is not type(b)
    }
    pairs = [f"{x} / {y}" for x, y in zip(ours, theirs) if x != y]
    return sorted(kinds) + ([f"{len(pairs)} rows differ", *pairs[:3]] if pairs else [])
