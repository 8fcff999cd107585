"""Spark results against DuckDB's for the same tables."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

BASE = "/root/testdata/sf0.001"


def present(base: str = BASE) -> bool:
    return Path(base, "posts.parquet").exists()


def _plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4) + 0.0
    return x if x is None or isinstance(x, (bool, int, str)) else str(x)


def differences(df, sql: str, base: str = BASE) -> tuple[list, list]:
    """Rows that only Spark has and rows that only DuckDB has, at most five of each; columns are matched by name."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(base).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = Counter(tuple(_plain(row[names.index(c)]) for c in order) for row in found.fetchall())
    ours = Counter(tuple(_plain(r[c]) for c in order) for r in df.select(*order).collect())
    return list((ours - theirs).items())[:5], list((theirs - ours).items())[:5]
