"""Runs a query in Spark and its SQL in DuckDB and compares the two results."""

from __future__ import annotations

import math
import os

import duckdb

from scoretables.sources.tables import BOUND


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BOUND:
        if os.path.exists(f"{folder}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, fn, sql: str, folder: str) -> list[str]:
    """Problems found; empty when both results agree."""
    df = fn(spark, folder)
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    out = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(names, want)
    kinds = {c: t for c, t in df.dtypes}
    for c, d in zip(names, cur.description):
        duck = str(d[1]).upper()
        if (kinds[c] in ("bigint", "int")) != ("INT" in duck):
            out.append(f"type {c}: {kinds[c]} vs {duck}")
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        only_a, only_b = list(set(a) - set(b))[:3], list(set(b) - set(a))[:3]
        out.append(f"{len(bad)} rows differ; columns {sorted(names)}; spark only {only_a}; sql only {only_b}")
    return out
