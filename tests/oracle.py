"""Runs a registered query and its SQL side by side, as the driver does."""

from __future__ import annotations

import math
import os
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    return float(f"{float(v):.9g}") if type(v).__name__ == "Decimal" else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, fn, sql: str, sf_dir: str) -> int:
    df = fn(spark, sf_dir)
    a = rows(df.columns, df.collect())
    cur = connect(sf_dir).execute(sql)
    b = rows([d[0] for d in cur.description], cur.fetchall())
    assert a[0] == b[0], (a[0], b[0])
    assert len(a[1]) == len(b[1]), (len(a[1]), len(b[1]))
    bad = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    assert not bad, (len(bad), bad[:2])
    return len(a[1])
