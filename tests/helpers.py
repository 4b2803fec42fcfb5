from __future__ import annotations

import re

from pyspark.sql import DataFrame


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    """The rows as plain tuples, in an order that NULLs do not break."""
    data = [tuple(row) for row in (df.select(*columns) if columns else df).collect()]
    return sorted(data, key=lambda row: [(value is None, str(value)) for value in row])


def by_key(df: DataFrame, key: str) -> dict:
    return {row[key]: row.asDict() for row in df.collect()}


def plan(df: DataFrame) -> str:
    """The physical plan after running the query, without the plans that AQE started from."""
    df.collect()
    kept, dropped_below = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        start = len(re.match("[ :|+-]*", line).group())
        if dropped_below is not None and start >= dropped_below:
            continue
        dropped_below = start if line[start:].startswith("== Initial Plan") else None
        if dropped_below is None:
            kept.append(line)
    return "\n".join(kept)
