"""Messages for items whose activity declines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from hemtally.operators.alerts import alert_metrics, alert_rows, declining, period_activity


def decline_alerts(
    activity: DataFrame, owners: DataFrame, run_date: date | str, threshold: float, subject: str
) -> DataFrame:
    """Message rows for items that fell by at least ``threshold`` from the same weekday a week before."""
    return alert_rows(alert_metrics(declining(period_activity(activity, run_date), threshold), owners), subject)
