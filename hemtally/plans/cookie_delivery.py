"""Hashes of an advertiser's visitors, from raw log files to the delivered file."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from hemtally.functions.dates import as_day, as_snapshot
from hemtally.operators.weblog import DAYS_BEFORE_END, advertiser_cookies, hashes_of_cookies, log_columns
from hemtally.sinks.delimited import write_delimited
from hemtally.sources.delimited import day_paths, present_paths, read_delimited
from hemtally.sources.snapshots import latest_value


def deliver_cookie_hashes(
    spark: SparkSession,
    log_base: str,
    graph: DataFrame,
    adv_id: str,
    out: str,
    start: date | str | None = None,
    end: date | str | None = None,
    graph_snapshot: str | None = None,
    most_missing: int | None = None,
) -> str:
    """Read ``log_base/yyyy/MM/dd/<hour>/`` for the window, write ``out/<end>`` as gzip TSV and return that path.

    Days without a folder are passed over; more than ``most_missing`` of them, or a window without any day, is an error.
    """
    newest = graph_snapshot or latest_value(graph)
    last = as_day(newest if end is None else end)
    first = last - timedelta(days=DAYS_BEFORE_END) if start is None else as_day(start)
    days, missing = present_paths(spark, day_paths(log_base, first, last))
    if not days or (most_missing is not None and len(missing) > most_missing):
        raise FileNotFoundError(f"{len(missing)} of {len(days) + len(missing)} days have no log, such as {missing[0]}")
    log = read_delimited(spark, days, log_columns())
    path = f"{out.rstrip('/')}/{as_snapshot(last)}"
    hashes = hashes_of_cookies(advertiser_cookies(log, adv_id), graph, newest)
    write_delimited(hashes, path, sep="\t", compression="gzip")
    return path
