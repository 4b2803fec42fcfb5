"""Run dates, snapshot strings and filters on day columns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT_FORMAT = "%Y%m%d"

# Formats of day columns kept as text, for Python and as a pattern of the text.
DAY_FORMATS = {"%Y-%m-%d": r"\d{4}-\d{2}-\d{2}", SNAPSHOT_FORMAT: r"\d{8}"}


def as_day(value: date | str) -> date:
    """A run date given as a date, ``yyyy-MM-dd`` or ``yyyyMMdd``."""
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    return datetime.strptime(value, "%Y-%m-%d" if "-" in value else SNAPSHOT_FORMAT).date()


def as_snapshot(value: date | str) -> str:
    return as_day(value).strftime(SNAPSHOT_FORMAT)


def days_before(run_date: date | str, first: int, last: int) -> list[date]:
    """The days from ``last`` to ``first`` days before the run date, oldest first."""
    run_day = as_day(run_date)
    return [run_day - timedelta(days=n) for n in range(last, first - 1, -1)]


def on_days(df: DataFrame, column: str, days: Iterable[date]) -> Column:
    """Filter on exact days, in the column's own type and text format so that partitions are pruned and files skipped."""
    written = day_format(df, column)
    return F.col(column).isin([day.strftime(written) for day in days] if written else list(days))


def between_days(df: DataFrame, column: str, first: Column, last: Column) -> Column:
    """Filter on a range of days, both ends included, in the column's own type and text format."""
    written = day_format(df, column)
    if written:
        pattern = written.replace("%Y", "yyyy").replace("%m", "MM").replace("%d", "dd")
        first, last = F.date_format(first, pattern), F.date_format(last, pattern)
    return F.col(column).between(first, last)


def day_value(df: DataFrame, column: str) -> Column:
    """The day column as a date; text that is no day is NULL."""
    day = F.col(column)
    if not isinstance(df.schema[column].dataType, T.StringType):
        return day.try_cast("date")
    return F.when(day.rlike(f"^{DAY_FORMATS[SNAPSHOT_FORMAT]}$"), F.try_to_date(day, "yyyyMMdd")).otherwise(day.try_cast("date"))


def day_format(df: DataFrame, column: str) -> str | None:
    """How a text column writes its days; None if it is of type date.

    For text alone, a job reads one value. Other formats are an error, as a comparison would match nothing in silence.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return None
    if not isinstance(kind, T.StringType):
        raise TypeError(f"{column} must be a date or text, not {kind.simpleString()}")
    one = df.select(column).filter(F.col(column).isNotNull()).first()
    for written, pattern in DAY_FORMATS.items():
        if one is None or re.fullmatch(pattern, one[0]):
            return written
    raise ValueError(f"{column} holds {one[0]!r}, which is no day as yyyy-MM-dd or yyyyMMdd")
