"""A query's result, kept as a dated CSV and loaded into a table that is replaced a day at a time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from hemtally.sinks.daily import load_rows, snapshot_rows
from hemtally.sinks.delimited import write_dated_csv
from hemtally.sources.shared import WrittenOnce


def daily_load(result: DataFrame, job: str, folder: str, target: str, run_date: date | str) -> str:
    """Write ``<folder>/<job>_<yesterday>``, load the same rows into ``target``, return the CSV's path.

    The query runs once. The rows are not read back from the CSV, which cannot tell an empty text from NULL.
    """
    with WrittenOnce(snapshot_rows(result, run_date), job) as rows:
        path = write_dated_csv(rows, folder, job, run_date)
        load_rows(rows, target, run_date)
    return path
