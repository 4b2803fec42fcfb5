"""Comparing a Spark result with DuckDB's answer."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def _plain(value: object) -> object:
    return round(value, 9) if isinstance(value, float) and not math.isnan(value) else value


def bag(columns: list[str], rows: list[tuple]) -> Counter:
    """Rows as a multiset, columns in name order."""
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return Counter(tuple(_plain(row[n]) for n in order) for row in rows)


def compare(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> None:
    answer = connection.execute(sql)
    expected_columns = [column[0] for column in answer.description]
    expected_rows = answer.fetchall()
    assert sorted(df.columns) == sorted(expected_columns)
    expected = bag(expected_columns, expected_rows)
    actual = bag(df.columns, [tuple(row) for row in df.collect()])
    assert sum(actual.values()) > 0
    assert actual == expected, f"only Spark: {list((actual - expected).items())[:5]}, only DuckDB: {list((expected - actual).items())[:5]}"
