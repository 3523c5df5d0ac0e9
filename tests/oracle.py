"""Compare a query's Spark result with its SQL in DuckDB: columns, rows, values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def compare(df, con, sql: str) -> str | None:
    """None if both sides agree, else a description of the first difference."""
    rel = con.sql(sql)
    want_cols = sorted(rel.columns)
    got_cols = sorted(df.columns)
    if want_cols != got_cols:
        return f"columns differ: spark {got_cols}, sql {want_cols}"
    want = sorted((tuple(_plain(r[rel.columns.index(c)]) for c in want_cols) for r in rel.fetchall()), key=_key)
    rows = df.select(*[f"`{c}`" for c in got_cols]).collect()
    got = sorted((tuple(_plain(v) for v in r) for r in rows), key=_key)
    if len(want) != len(got):
        return f"rows differ: spark {len(got)}, sql {len(want)}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"first difference in {got_cols}:\n spark {g}\n sql   {w}"
    return None
