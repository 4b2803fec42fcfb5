"""The lookback counts of a partner's email list, in one pass or kept up to date day by day."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemtally.functions.dates import as_day, day_value, days_before
from hemtally.operators.audience import (
    CATEGORY,
    DETAIL_DAYS,
    IMPRESSION,
    MAX_DAYS,
    USER_AGENT,
    audience_members,
    category_counts,
    daily_counts,
    flat_impressions,
    hash_match_counts,
    lookback,
    matched_counts,
    user_agent_counts,
)
from hemtally.sinks.daily import write_days
from hemtally.sinks.delimited import write_delimited
from hemtally.sources.shared import WrittenOnce
from hemtally.sources.snapshots import latest_value


def audience_run(
    impressions: DataFrame,
    emails: DataFrame,
    folder: str,
    run_date: date | str,
    skip_dates: Iterable[date | str] = (),
    snapshot: str | None = None,
    store: str | None = None,
    max_files: int | None = None,
) -> None:
    """Write the three counts as CSV below ``folder``.

    Without a ``store`` the impressions are read and met with the list once: their finest counts are written to the shared folder, the three
    results come from those. With one, daily counts are kept there for each email snapshot, and a later run, or one that
    takes up a failed run, reads the impressions of the days it lacks only.
    """
    skipped = list(skip_dates)
    flat = flat_impressions(impressions)
    if snapshot is None:
        snapshot = latest_value(emails)
    members = audience_members(emails, snapshot)
    if store is None:
        with WrittenOnce(matched_counts(lookback(flat, run_date, MAX_DAYS, skipped), members), "matched-counts") as matched:
            for name, _, _, count in _RESULTS:
                write_delimited(count(matched), f"{folder.rstrip('/')}/{name}", max_files=max_files)
        return
    for name, keys, days, count in _RESULTS:
        kept = f"{store.rstrip('/')}/{snapshot}/{name}"
        refresh_daily_counts(flat, members, kept, run_date, keys, days, skipped)
        result = count(read_daily_counts(flat, kept, run_date, keys, days, skipped))
        write_delimited(result, f"{folder.rstrip('/')}/{name}", max_files=max_files)


def read_run(impressions: DataFrame, folder: str) -> DataFrame:
    """The three files of a run in one table, ``result`` telling which; columns that a result lacks are NULL. ``impressions`` tells the types of the keys."""
    spark, parts = impressions.sparkSession, []
    flat = flat_impressions(impressions).select(*IMPRESSION)
    for name, _, _, count in _RESULTS:
        empty = count(flat.withColumns({"days_since": F.lit(0), "n": F.lit(0).cast("long")}))
        read = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in empty.schema])).csv(f"{folder.rstrip('/')}/{name}")
        parts.append(read.withColumn("result", F.lit(name)))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def refresh_daily_counts(
    impressions: DataFrame,
    members: DataFrame,
    store: str,
    run_date: date | str,
    keys: Sequence[str] = ("md5",),
    max_days: int = MAX_DAYS,
    skip_dates: Iterable[date | str] = (),
    redo: Iterable[date | str] = (),
) -> list[date]:
    """Add the window's missing days to a store of daily counts; returns the days that were computed.

    The store is a parquet table partitioned by ``date_p``, one per email snapshot and set of keys. Its days do not
    depend on the run date. Days in ``redo`` are computed again and replaced, e.g. after late impressions. Every day that was
    computed has a row that marks it, the only one where nothing matched: it is not read again, and a day computed again without
    matches loses the rows it had.
    """
    skipped = {as_day(day) for day in skip_dates}
    none = lookback(impressions, run_date, 0)
    _days(daily_counts(none, keys)).write.mode("ignore").partitionBy("date_p").parquet(store)
    # At most max_days values.
    kept = _store_rows(impressions, store, run_date, (), max_days).select("date_p").distinct().collect()
    stored = {row.date_p for row in kept} - {as_day(day) for day in redo}
    window = [day for day in days_before(run_date, 1, max_days) if day not in skipped]
    missing = [day for day in window if day not in stored]
    if missing:
        rows = lookback(impressions, run_date, max_days, skip_dates=skipped | stored)
        counts = _days(daily_counts(rows, keys, members))
        marked = counts.unionByName(_markers(counts, missing))
        # Each day's rows together, so that a task writes few files; a large day is split.
        write_days(marked.hint("rebalance", "date_p"), store, "date_p")
    return missing


def _markers(counts: DataFrame, days: Sequence[date]) -> DataFrame:
    """A row that counts nothing for each day: it keeps the day's partition, and replaces what the day held before."""
    values = [tuple(day if name == "date_p" else 0 if name == "n" else None for name in counts.columns) for day in days]
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in counts.schema])
    return counts.sparkSession.createDataFrame(values, nullable)


def read_daily_counts(
    impressions: DataFrame,
    store: str,
    run_date: date | str,
    keys: Sequence[str] = ("md5",),
    max_days: int = MAX_DAYS,
    skip_dates: Iterable[date | str] = (),
) -> DataFrame:
    """The stored days of the window with ``days_since``, ready for the count operators.

    ``impressions`` only tells the types of the keys, so that a store without any match can be read.
    """
    return _store_rows(impressions, store, run_date, keys, max_days, skip_dates).filter(F.col("n") > 0)


def _store_rows(
    impressions: DataFrame,
    store: str,
    run_date: date | str,
    keys: Sequence[str],
    max_days: int,
    skip_dates: Iterable[date | str] = (),
) -> DataFrame:
    fields = [impressions.schema[key] for key in keys]
    schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("date_p", T.DateType())])
    return lookback(impressions.sparkSession.read.schema(schema).parquet(store), run_date, max_days, skip_dates)


def _days(counts: DataFrame) -> DataFrame:
    return counts.withColumn("date_p", day_value(counts, "date_p"))


# The results of a run: name, keys, lookback days, and what counts them.
_RESULTS = (
    ("hash_match_counts", ("md5",), MAX_DAYS, hash_match_counts),
    ("user_agent_counts", USER_AGENT, DETAIL_DAYS, user_agent_counts),
    ("category_counts", CATEGORY, DETAIL_DAYS, category_counts),
)
