"""Tables partitioned by day, in which a load replaces whole days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemtally.functions.dates import days_before


def write_days(df: DataFrame, target: str, day_column: str) -> None:
    """Replace the days that ``df`` holds and keep all others; a job that fails before its commit changes nothing."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(day_column)
        .parquet(target)
    )


def snapshot_rows(df: DataFrame, run_date: date | str, day_column: str = "event_date") -> DataFrame:
    """Distinct rows, dated the day before the run unless they bring a date.

    The day column is the partition and a date. Of a timestamp the calendar day becomes the partition, and the instant is kept as
    ``<day_column>_at``; other types are refused before any job.
    """
    if day_column not in df.columns:
        (yesterday,) = days_before(run_date, 1, 1)
        return df.dropDuplicates().withColumn(day_column, F.lit(yesterday))
    kind = df.schema[day_column].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        df = df.withColumn(f"{day_column}_at", F.col(day_column)).withColumn(day_column, F.to_date(day_column))
    elif not isinstance(kind, T.DateType):
        raise TypeError(f"{day_column} must be a date or a timestamp, not {kind.simpleString()}")
    # Many days: gather each day's rows so that a task writes few files. Rebalancing splits a day that is too
    # large for one task, where repartition(day) would not.
    return df.dropDuplicates().hint("rebalance", day_column)


def load_snapshot(df: DataFrame, target: str, run_date: date | str, day_column: str = "event_date") -> None:
    """Load a query result into ``target``: the day before the run, and every other day in it, is replaced.

    Loading the same result again changes nothing. A result without rows for the day before the run empties that
    day, as a delete and reload would.
    """
    load_rows(snapshot_rows(df, run_date, day_column), target, run_date, day_column)


def load_rows(rows: DataFrame, target: str, run_date: date | str, day_column: str = "event_date") -> None:
    """``load_snapshot`` of rows that ``snapshot_rows`` made."""
    (yesterday,) = days_before(run_date, 1, 1)
    loaded = Observation()
    on_the_day = F.count_if(F.col(day_column) == F.lit(yesterday))
    write_days(rows.observe(loaded, on_the_day.alias("on_the_day")), target, day_column)
    if loaded.get["on_the_day"] == 0:
        rows.drop(day_column).limit(0).write.mode("overwrite").parquet(f"{target.rstrip('/')}/{day_column}={yesterday}")
