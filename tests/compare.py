"""Run catalogue queries in Spark and their SQL twins in DuckDB and compare all rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def as_lines(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([row[i] for i in order]) for row in rows)


def difference(spark, folder: str, name: str) -> str | None:
    """None if the query and its SQL agree, else what differs first."""
    df = contract.queries()[name](spark, folder)
    columns, left = as_lines(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck(folder).execute(contract.oracle_sql()[name])
    sql_columns, right = as_lines([d[0] for d in cursor.description], cursor.fetchall())
    if columns != sql_columns:
        return f"columns {columns} against {sql_columns}"
    if len(left) != len(right):
        extra = set(left) ^ set(right)
        return f"{len(left)} rows against {len(right)}, e.g. {sorted(extra)[:4]}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} of {len(left)} rows differ, e.g. {wrong[:3]}" if wrong else None


if __name__ == "__main__":
    from conftest import local_session

    session = local_session()
    folder, names = sys.argv[1], sys.argv[2:] or list(contract.queries())
    for query in names:
        began = time.time()
        try:
            verdict = difference(session, folder, query) or "same"
        except Exception as error:  # noqa: BLE001 - a report, not a handler
            verdict = f"error {str(error)[:600]}"
        print(f"{query:42s} {time.time() - began:6.1f}s {verdict}", flush=True)
