"""Compare a query with its SQL on DuckDB."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, Decimal):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, bytearray):
        return bytes(x)
    return x


def rows(columns: list[str], data) -> list:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def kind(t: str) -> str:
    t = t.lower()
    for mark, to in (("decimal", "decimal"), ("bigint", "long"), ("hugeint", "huge"), ("integer", "int"), ("varchar", "string"), ("double", "double"), ("float", "float"), ("boolean", "boolean")):
        if t.startswith(mark):
            return to + ("[]" if t.endswith("[]") else "")
    return t


def compare(spark, query, sql: str, folder: str) -> tuple[str, int]:
    """('' or what differs, rows)."""
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    rel = connect(folder).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} against {sorted(rel.columns)}", len(got)
    mine = {n: {"bigint": "long"}.get(t, t) for n, t in df.dtypes}
    theirs = {n: kind(str(t)) for n, t in zip(rel.columns, rel.types, strict=True)}
    odd = {n: (mine[n], theirs[n]) for n in mine if theirs[n] in ("long", "int", "string", "double", "float", "boolean", "huge", "decimal") and mine[n] != theirs[n]}
    if got != want:
        k = next((i for i, (a, b) in enumerate(zip(got, want)) if a != b), min(len(got), len(want)))
        return f"{len(got)} against {len(want)} rows; first difference {got[k : k + 1]} against {want[k : k + 1]}", len(got)
    return (f"types {odd}" if odd else ""), len(got)
