"""Run registered queries next to their SQL and compare whole results."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    rows = [tuple(r) for r in frame[names].itertuples(index=False)]
    return names, sorted(rows, key=repr)


def differences(spark_frame, duck_frame) -> str | None:
    left_names, left = rows_of(spark_frame)
    right_names, right = rows_of(duck_frame)
    if left_names != right_names:
        return f"columns {left_names} / {right_names}"
    if len(left) != len(right):
        return f"row counts {len(left)} / {len(right)}"
    kinds = [(n, str(spark_frame[n].dtype), str(duck_frame[n].dtype)) for n in left_names]
    unlike = [k for k in kinds if k[1] != k[2]]
    if unlike:
        return f"types {unlike}"
    off = [(a, b) for a, b in zip(left, right) if repr(a) != repr(b)]
    return f"{len(off)} rows differ, first {off[0]}" if off else None
