"""Order-free comparison of a Spark result with DuckDB over the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def same(df, sql: str | None, sf_dir: str) -> str:
    """'same' or what differs; without SQL only the number of rows."""
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows {len(ours)}"
    cursor = connect(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if ours != theirs:
        first = next(((a, b) for a, b in zip(ours, theirs) if a != b), None)
        return f"differ: {len(ours)} / {len(theirs)} rows, first {first}"
    return "same"
