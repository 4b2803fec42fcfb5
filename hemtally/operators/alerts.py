"""Activity of items over two weeks, and message rows for those that decline."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemtally.functions.dates import as_day, days_before, on_days
from hemtally.functions.text import html_escape

# Status texts, the message's first part, and the labels of its details with the columns they show.
STOPPED = "did not participate"
DECLINED = "declined significantly"
GREETING = (
    "Hi there %s, <br> <br> A template you are the PDM for &mdash; %s (id: %s) &mdash; %s yesterday. "
    "Please check it out. <br>"
)
DETAILS = "<br> <u>Details</u> <br> <br>"
NAMED_DETAILS = (
    ("Media Group Name", "media_group_name", "media_group_id"),
    ("Publisher Name", "pub_name", "publisher_id"),
    ("Template Name", "template_name", "template_id"),
)
COUNTED_DETAILS = (
    ("Decisions Yesterday", "decisions"),
    ("Decisions Same Day Last Week", "pdow_decisions"),
    ("Total Decisions This Week", "week_decisions"),
    ("Total Decisions Last Week", "previous_week_decisions"),
)


def period_activity(
    activity: DataFrame,
    run_date: date | str,
    key: str = "template_id",
    measure: str = "decisions",
    date_col: str = "activity_date",
) -> DataFrame:
    """``[key, d1, d8, w1, w2]``: yesterday, the same weekday a week before, the last 7 days, the 7 before those.

    Reads the 14 days it needs; a key without any activity in them has no row.
    """
    since = F.datediff(F.lit(as_day(run_date)), F.col(date_col).try_cast("date"))

    def total(first: int, last: int) -> Column:
        return F.coalesce(F.sum(F.when(since.between(first, last), F.col(measure))), F.lit(0))

    return (
        activity.filter(on_days(activity, date_col, days_before(run_date, 1, 14)))
        .groupBy(key)
        .agg(
            total(1, 1).alias("d1"), total(8, 8).alias("d8"), total(1, 7).alias("w1"), total(8, 14).alias("w2")
        )
    )


def declining(periods: DataFrame, threshold: float) -> DataFrame:
    """Items that fell by at least this share from the same weekday a week before, e.g. 0.5 for half."""
    return periods.filter((F.col("d8") > 0) & (F.col("d1") <= F.col("d8") * (1 - threshold)))


def alert_metrics(periods: DataFrame, owners: DataFrame, key: str = "template_id") -> DataFrame:
    """Period counts with the owner columns a message shows, under the names that ``alert_rows`` reads."""
    return periods.withColumnsRenamed(
        {"d1": "decisions", "d8": "pdow_decisions", "w1": "week_decisions", "w2": "previous_week_decisions"}
    ).join(owners, key)


def alert_rows(metrics: DataFrame, subject: str) -> DataFrame:
    """One message per row: ``[recipient, subject, status, body]``, the body as HTML with escaped values."""
    status = F.when(F.col("decisions") == 0, STOPPED).otherwise(DECLINED)
    greeting = F.format_string(
        GREETING,
        html_escape(F.col("am_name")),
        html_escape(F.col("template_name")),
        html_escape(F.col("template_id")),
        status,
    )
    named = [
        F.format_string(f"<b>{label}</b>: %s (id: %s) <br>", html_escape(F.col(name)), html_escape(F.col(number)))
        for label, name, number in NAMED_DETAILS
    ]
    counted = [
        F.format_string(f"<b>{label}</b>: %s <br>", html_escape(F.col(column))) for label, column in COUNTED_DETAILS
    ]
    return metrics.select(
        F.trim("email_address").alias("recipient"),
        F.lit(subject).alias("subject"),
        status.alias("status"),
        F.concat_ws(" ", greeting, F.lit(DETAILS), *named, *counted).alias("body"),
    )
