"""Comparison of a query's rows with those of its DuckDB SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        source = f"{f}/*.parquet" if f.is_dir() else str(f)
        con.execute(f"create view {f.stem} as select * from read_parquet('{source}')")
    return con


def _plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    return bytes(value) if isinstance(value, bytearray) else value


def same_rows(frame, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    names = sorted(frame.columns)
    got = sorted((repr([_plain(r[c]) for c in names]) for r in frame.collect()))
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    want = sorted(repr([_plain(r[k]) for k in order]) for r in found.fetchall())
    assert got == want
