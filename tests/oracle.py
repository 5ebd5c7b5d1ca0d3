"""Holds a query's rows against its SQL, as sorted values with columns by name."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    return db


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if type(x).__name__ == "Decimal":
        return plain(float(x))
    if isinstance(x, bool):
        return x
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, sf_dir: str, query, sql: str) -> str:
    """Empty when both agree; else what differs."""
    df = query(spark, sf_dir)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = connect(sf_dir).execute(sql)
    want_names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != want_names:
        return f"columns {names} against {want_names}"
    if got != want:
        a, b = [r for r in got if r not in set(want)][:3] if len(want) < 200000 else [], [r for r in want if r not in set(got)][:3] if len(got) < 200000 else []
        return f"{len(got)} rows against {len(want)}; only here {a}; only there {b}"
    return ""
