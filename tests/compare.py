"""Compares a DataFrame with what DuckDB makes of the same Parquet tables."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

DATA = Path("/root/testdata")


def plain(value):
    """A value as both engines would print it: doubles to nine digits, containers as tuples."""
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return float(value)


def normal(rows, names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def same(df: DataFrame, sql: str, sf_dir: str) -> None:
    """Fails unless names and rows agree."""
    want = duck(sf_dir).execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    ours, theirs = normal(df.collect(), df.columns), normal(want.fetchall(), names)
    if ours != theirs:
        wrong = [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b][:3]
        raise AssertionError(f"{len(ours)} rows here, {len(theirs)} there; columns {sorted(names)}; first that differ: {wrong}")
