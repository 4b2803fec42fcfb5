"""Delimited text output."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from hemtally.functions.dates import days_before
from hemtally.sources.shared import WrittenOnce


def write_delimited(
    df: DataFrame,
    path: str,
    sep: str = ",",
    mode: str = "overwrite",
    header: bool = False,
    compression: str | None = None,
    max_files: int | None = None,
) -> None:
    """Write as text. AQE sizes the files; ``max_files`` caps their number.

    With a cap the query first writes its rows to the shared folder, in as many tasks as AQE gives it for their size. At most ``max_files`` tasks turn
    the stored files into text, each several of them, without a shuffle. ``coalesce`` on the query itself would run its whole last stage, joins
    and aggregates included, in that few tasks.
    """
    if max_files is not None:
        with WrittenOnce(df.toDF(*(f"c{n}" for n in range(len(df.columns)))), "sized") as rows:
            write_delimited(rows.coalesce(max_files).toDF(*df.columns), path, sep, mode, header, compression)
        return
    writer = df.write.mode(mode).option("sep", sep).option("header", header)
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)


def write_dated_csv(df: DataFrame, folder: str, job: str, run_date: date | str) -> str:
    """Write ``<folder>/<job>_<yesterday>`` as CSV with a header and return that path."""
    if job.endswith(".csv"):
        raise ValueError("give the job name without a file type")
    (yesterday,) = days_before(run_date, 1, 1)
    path = f"{folder.rstrip('/')}/{job}_{yesterday}"
    write_delimited(df, path, header=True)
    return path
