"""Rows of a Spark query beside those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if names and rows agree."""
    con = duck(sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = rows(df.columns, df.collect()), rows(names, found.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    return next((f"{a} and {b}" for a, b in zip(ours, theirs, strict=True) if a != b), "")
