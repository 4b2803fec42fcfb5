"""Impressions of a partner's email list, counted over lookback days."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemtally.functions.dates import as_day, day_value, days_before, on_days
from hemtally.operators.keys import apart, key_list
from hemtally.sources.snapshots import at_snapshot

# Lookback days in total, those of the cumulative windows, of the detail counts, and of the coverage
# buckets, with the bucket for everything beyond.
MAX_DAYS = 181
WINDOWS = (30, 60, 90)
WINDOWS_WITH_180 = (30, 60, 90, 180)
DETAIL_DAYS = 45
COVERAGE_DAYS = (30, 45, 60, 90, 180)
COVERAGE_BEYOND = 181

USER_AGENT = ("md5", "ip", "dev_type", "dev_maker", "nbrowser", "os")
CATEGORY = ("md5", "category_id")
IMPRESSION = (*USER_AGENT, "category_id")


def audience_members(emails: DataFrame, snapshot: str | None = None) -> DataFrame:
    """``[md5]`` of one snapshot of the email list."""
    return at_snapshot(emails, snapshot).select("md5")


def in_audience(df: DataFrame, members: DataFrame | None, unique: bool = False) -> DataFrame:
    """Rows whose md5 is listed; all rows if there is no list.

    Best placed after an aggregation by md5: frequent hashes arrive combined, and for a short list Catalyst
    moves the join below it, down to the scan. Before one by keys that hardly combine. ``unique`` tells that ``df`` is grouped by md5 alone; a distinct list
    then joins it without a further shuffle.
    """
    if members is None:
        return df
    listed = members.select("md5").distinct() if unique else key_list(members, "md5")
    return df.join(listed, "md5", "left_semi")


def lookback(
    impressions: DataFrame,
    run_date: date | str,
    max_days: int = MAX_DAYS,
    skip_dates: Iterable[date | str] = (),
    date_col: str = "date_p",
) -> DataFrame:
    """Impressions of the days 1 to ``max_days`` before the run, with ``days_since``. Only those days are read."""
    skipped = {as_day(day) for day in skip_dates}
    days = [day for day in days_before(run_date, 1, max_days) if day not in skipped]
    since = F.datediff(F.lit(as_day(run_date)), day_value(impressions, date_col))
    return impressions.filter(on_days(impressions, date_col, days)).withColumn("days_since", since)


def audience_impressions(
    impressions: DataFrame,
    emails: DataFrame,
    run_date: date | str,
    max_days: int = MAX_DAYS,
    skip_dates: Iterable[date | str] = (),
    snapshot: str | None = None,
    ip: str = "request.ip",
) -> DataFrame:
    """Impressions of listed hashes, ``ip`` being taken from the request structure."""
    rows = lookback(impressions, run_date, max_days, skip_dates)
    rows = flat_impressions(rows, ip).select(*IMPRESSION, "days_since")
    return in_audience(rows, audience_members(emails, snapshot))


def flat_impressions(impressions: DataFrame, ip: str = "request.ip") -> DataFrame:
    """The request's address as a plain column."""
    return impressions.withColumn("ip", F.col(ip))


def hash_match_counts(
    rows: DataFrame, members: DataFrame | None = None, windows: Sequence[int] = WINDOWS
) -> DataFrame:
    """``[md5, ct_30, ct_60, ct_90]``: impressions per hash within each cumulative window, NULL where none.

    ``rows`` are impressions with ``days_since``, or daily counts of them. The hashes are counted first and then
    restricted to ``members``: one shuffle by md5 serves both.
    """
    counts = rows.groupBy("md5").agg(
        *(F.sum(F.when(F.col("days_since") <= days, _count(rows))).alias(f"ct_{days}") for days in windows)
    )
    return in_audience(counts, members, unique=True)


def user_agent_counts(rows: DataFrame, members: DataFrame | None = None, days: int = DETAIL_DAYS) -> DataFrame:
    """Impressions per hash, address and device within ``days``."""
    return _detail_counts(rows, members, USER_AGENT, days)


def category_counts(rows: DataFrame, members: DataFrame | None = None, days: int = DETAIL_DAYS) -> DataFrame:
    """Impressions per hash and content category within ``days``."""
    return _detail_counts(rows, members, CATEGORY, days)


def daily_counts(
    rows: DataFrame, keys: Sequence[str] = ("md5",), members: DataFrame | None = None, date_col: str = "date_p"
) -> DataFrame:
    """Impressions per day and key, ``[<date_col>, <keys>, n]``: what can be kept and merged on a later run date.

    ``days_since`` is left out on purpose. It depends on the run date, so it is derived again from the day when the
    counts are merged.
    """
    if tuple(keys) == ("md5",):
        counts = rows.groupBy(date_col, *keys).agg(F.count("*").alias("n"))
        return in_audience(counts, members).select(date_col, *keys, "n")
    return _listed_apart(rows, members).groupBy(date_col, *keys).agg(F.count("*").alias("n"))


def matched_counts(rows: DataFrame, members: DataFrame | None = None, days: int = DETAIL_DAYS) -> DataFrame:
    """The finest counts that all results of a run come from: impressions of listed hashes per window, and within ``days`` per device and category.

    ``[md5, <device>, category_id, days_since, n]``, where ``days_since`` is the end of the window that the impressions fall into. Older impressions
    carry no device and no category, which nothing asks of them, so they combine to a few rows per hash.
    """
    since = F.col("days_since")
    window = since
    for end in sorted({*WINDOWS_WITH_180, days}, reverse=True):
        window = F.when(since <= end, end).otherwise(window)
    details = [F.when(since <= days, F.col(name)).alias(name) for name in IMPRESSION if name != "md5"]
    listed = _listed_apart(rows.select(*IMPRESSION, "days_since", _count(rows).cast("long").alias("n")), members)
    listed = listed.select("md5", *details, window.alias("days_since"), "n")
    return listed.groupBy(*IMPRESSION, "days_since").agg(F.sum("n").alias("n"))


def date_coverage(
    impressions: DataFrame, run_date: date | str, max_days: int = MAX_DAYS, date_col: str = "date_p"
) -> DataFrame:
    """``[date_part, dates]``: how many days that have impressions fall into each exclusive lookback bucket.

    Reads the day column only, reduced to its distinct values in every task.
    """
    since = F.col("days_since")
    bucket = F.lit(COVERAGE_BEYOND)
    for days in reversed(COVERAGE_DAYS):
        bucket = F.when(since <= days, days).otherwise(bucket)
    return (
        lookback(impressions, run_date, max_days, date_col=date_col)
        .select("days_since")
        .distinct()
        .groupBy(bucket.alias("date_part"))
        .agg(F.count("*").alias("dates"))
    )


def _detail_counts(rows: DataFrame, members: DataFrame | None, keys: Sequence[str], days: int) -> DataFrame:
    # These keys hardly combine, so non-members go first: they are shuffled once at most.
    recent = _listed_apart(rows.filter(F.col("days_since") <= days), members)
    return recent.groupBy(*keys).agg(F.sum(_count(rows)).alias(f"ct_{days}"))


def _listed_apart(rows: DataFrame, members: DataFrame | None) -> DataFrame:
    """Listed rows to aggregate by more than the hash: a hash with very many rows is split over tasks."""
    return rows if members is None else apart(in_audience(rows, members), "md5")


def _count(rows: DataFrame) -> Column:
    """What a row stands for: its daily count if it has one, else one impression."""
    return F.col("n") if "n" in rows.columns else F.lit(1)
