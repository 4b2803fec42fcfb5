from __future__ import annotations

from datetime import date, timedelta

from hemtally.operators import alert_rows, declining, period_activity
from hemtally.plans import decline_alerts
from helpers import rows

RUN = date(2024, 1, 31)


def activity(spark, *data):
    return spark.createDataFrame(
        [(key, RUN - timedelta(days=days), n) for key, days, n in data],
        "template_id long, activity_date date, decisions long",
    )


def owners(spark):
    return spark.createDataFrame(
        [(1, "T <1> & \"co\"", " a@example.com ", "Ann", 7, "Pub", 8, "Group"), (2, "T2", "b@example.com", "Bo", 7, "Pub", 8, "Group")],
        "template_id long, template_name string, email_address string, am_name string, publisher_id long, "
        "pub_name string, media_group_id long, media_group_name string",
    )


def test_periods(spark):
    df = activity(spark, (1, 1, 5), (1, 7, 2), (1, 8, 9), (1, 14, 1), (1, 15, 100), (1, 0, 100), (2, 9, 4), (3, 15, 1))
    assert rows(period_activity(df, RUN)) == [(1, 5, 9, 7, 10), (2, 0, 0, 0, 4)]


def test_decline_is_measured_against_the_same_weekday(spark):
    df = spark.createDataFrame([(1, 5, 10), (2, 6, 10), (3, 0, 0), (4, 0, 1)], "k long, d1 long, d8 long")
    assert rows(declining(df, 0.5), "k") == [(1,), (4,)]


def test_messages(spark):
    df = activity(spark, (1, 8, 10), (2, 1, 3), (2, 8, 10), (3, 8, 10))
    result = {row.recipient: row for row in decline_alerts(df, owners(spark), RUN, 0.5, "Subject").collect()}
    assert result["a@example.com"].status == "did not participate"
    assert result["b@example.com"].status == "declined significantly"
    assert set(result) == {"a@example.com", "b@example.com"}
    body = result["a@example.com"].body
    assert "T &lt;1&gt; &amp; &quot;co&quot; (id: 1)" in body
    assert "<b>Decisions Same Day Last Week</b>: 10 <br>" in body
    assert result["a@example.com"].subject == "Subject"


def test_rows_of_a_ready_made_view(spark):
    view = owners(spark).selectExpr(
        "*", "0L as decisions", "3L as pdow_decisions", "4L as week_decisions", "5L as previous_week_decisions"
    )
    assert {row.status for row in alert_rows(view, "s").collect()} == {"did not participate"}
