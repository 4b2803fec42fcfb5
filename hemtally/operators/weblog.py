"""From an advertiser's web log to the hashes attached to its visitors' cookies."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemtally.functions.dates import as_day, between_days
from hemtally.operators.keys import key_list
from hemtally.sources.snapshots import at_snapshot

# Field positions in the raw log (counted from 0), how many fields it needs, the text for a missing
# cookie, and how many days before the end the default window starts.
ADVERTISER_FIELD = 23
FIRST_PARTY_FIELD = 6
THIRD_PARTY_FIELD = 8
FIELD_COUNT = 24
MISSING = "null"
DAYS_BEFORE_END = 6


def log_columns() -> list[str]:
    """Names for the raw log's fields, in file order."""
    columns = [f"_c{n}" for n in range(FIELD_COUNT)]
    columns[ADVERTISER_FIELD] = "adv_id"
    columns[FIRST_PARTY_FIELD] = "domain_user_id"
    columns[THIRD_PARTY_FIELD] = "linked_cookie"
    return columns


def advertiser_cookies(weblog: DataFrame, adv_id: str) -> DataFrame:
    """``[cookie]`` of both kinds, without NULL and the text ``null``. Reads the log once."""
    return (
        weblog.filter(F.col("adv_id") == adv_id)
        .select(F.explode(F.array("linked_cookie", "domain_user_id")).alias("cookie"))
        .filter(F.col("cookie") != MISSING)
    )


def hashes_of_cookies(cookies: DataFrame, graph: DataFrame, snapshot: str | None = None) -> DataFrame:
    """Distinct ``[hem]`` of the graph edges whose cookie is listed, in one snapshot of the graph.

    The graph is only filtered by the cookies (semi join), so edges are neither de-duplicated nor multiplied for it,
    and a cookie with very many edges can be split over tasks.
    """
    wanted = key_list(cookies, "cookie")
    edges = at_snapshot(graph, snapshot).join(wanted, "cookie", "left_semi")
    return edges.select(F.col("hash").alias("hem")).distinct()


def cookies_to_hashes(
    weblog: DataFrame,
    graph: DataFrame,
    adv_id: str,
    start: date | str | None = None,
    end: date | str | None = None,
) -> DataFrame:
    """Hashes for one advertiser's visitors within a window of days, both ends included.

    The window ends at the newest graph snapshot and starts six days before its end unless given. The graph is always
    read at its newest snapshot.
    """
    if end is not None:
        last = F.lit(as_day(end))
    else:
        last = graph.agg(F.to_date(F.max("date_p"), "yyyyMMdd")).scalar()
    if start is not None:
        first = F.lit(as_day(start))
    elif end is not None:
        first = F.lit(as_day(end) - timedelta(days=DAYS_BEFORE_END))
    else:
        first = F.date_sub(last, DAYS_BEFORE_END)
    window = between_days(weblog, "log_date", first, last)
    return hashes_of_cookies(advertiser_cookies(weblog.filter(window), adv_id), graph)
