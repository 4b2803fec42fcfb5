from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from hemtally.operators import (
    audience_impressions,
    audience_members,
    category_counts,
    date_coverage,
    hash_match_counts,
    lookback,
    user_agent_counts,
)
from hemtally.operators.audience import WINDOWS_WITH_180, flat_impressions
from hemtally.plans import audience_run, read_daily_counts, refresh_daily_counts
from helpers import rows

RUN = date(2020, 12, 1)
SCHEMA = (
    "md5 string, request struct<ip: string>, dev_type string, dev_maker string, nbrowser string, os string, "
    "category_id string, date_p {}"
)


def seen(md5, days, category="c1", ip="1.1.1.1"):
    return (md5, (ip,), "phone", "m", "b", None, category, RUN - timedelta(days=days))


def impressions(spark, data, text=False):
    if text:
        data = [(*row[:-1], row[-1].isoformat()) for row in data]
    return spark.createDataFrame(data, SCHEMA.format("string" if text else "date"))


@pytest.fixture
def emails(spark):
    return spark.createDataFrame(
        [("a", "20201101"), ("a", "20201101"), ("b", "20201101"), (None, "20201101"), ("z", "20201001")],
        "md5 string, date_p string",
    )


DATA = [
    seen("a", 0),
    seen("a", 1),
    seen("a", 1),
    seen("a", 30),
    seen("a", 31, "c2"),
    seen("a", 45, None),
    seen("a", 46),
    seen("a", 90),
    seen("b", 91),
    seen("b", 181),
    seen("b", 182),
    seen("z", 1),
    seen(None, 1),
]


@pytest.mark.parametrize("text", [False, True])
def test_impressions_of_listed_hashes_in_the_window(spark, emails, text):
    df = audience_impressions(impressions(spark, DATA, text), emails, RUN)
    assert rows(df, "md5", "days_since") == sorted(
        [("a", n) for n in (1, 1, 30, 31, 45, 46, 90)] + [("b", 181), ("b", 91)], key=lambda row: (row[0], str(row[1]))
    )
    assert df.columns[:2] == ["md5", "ip"] and df.first().ip == "1.1.1.1"


def test_skipped_days_and_malformed_days_are_left_out(spark, emails):
    df = impressions(spark, DATA, text=True)
    bad = spark.createDataFrame([(*seen("a", 2)[:-1], "2020-11-29x"), (*seen("a", 2)[:-1], None)], df.schema)
    result = audience_impressions(df.union(bad), emails, RUN, max_days=31, skip_dates=["2020-11-30"])
    assert rows(result, "md5", "days_since") == [("a", 30), ("a", 31)]


def test_email_list_of_a_given_snapshot(spark, emails):
    assert rows(audience_members(emails, "20201001")) == [("z",)]
    assert rows(audience_members(emails)) == [("a",), ("a",), ("b",), (None,)]
    assert rows(audience_impressions(impressions(spark, DATA), emails, RUN, 5, snapshot="20201001"), "md5") == [("z",)]


def test_windows_are_cumulative_and_empty_ones_null(spark, emails):
    members = audience_members(emails)
    recent = lookback(impressions(spark, DATA), RUN)
    assert rows(hash_match_counts(recent, members)) == [("a", 3, 6, 7), ("b", None, None, None)]
    assert rows(hash_match_counts(recent, members, WINDOWS_WITH_180)) == [("a", 3, 6, 7, 7), ("b", None, None, None, 1)]


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_counting_before_or_after_the_list_is_the_same(spark, emails, conf, threshold):
    conf(spark__sql__autoBroadcastJoinThreshold=threshold)
    df, members = impressions(spark, DATA), audience_members(emails)
    joined = audience_impressions(df, emails, RUN)
    raw = flat_impressions(lookback(df, RUN))
    for count in (hash_match_counts, user_agent_counts, category_counts):
        assert rows(count(joined)) == rows(count(raw, members))


def test_detail_counts_keep_null_keys_and_stop_at_45_days(spark, emails):
    raw = flat_impressions(lookback(impressions(spark, DATA), RUN))
    members = audience_members(emails)
    assert rows(category_counts(raw, members)) == [("a", "c1", 3), ("a", "c2", 1), ("a", None, 1)]
    assert rows(user_agent_counts(raw, members)) == [("a", "1.1.1.1", "phone", "m", "b", None, 5)]


def test_coverage_buckets_are_exclusive(spark):
    assert rows(date_coverage(impressions(spark, DATA), RUN)) == [(180, 1), (181, 1), (30, 2), (45, 2), (60, 1), (90, 1)]


def test_daily_counts_match_one_pass_on_two_run_dates(spark, emails, tmp_path):
    df, members, store = impressions(spark, DATA), audience_members(emails), str(tmp_path / "store")
    later = RUN + timedelta(days=40)
    for run in (RUN, later):
        refresh_daily_counts(df, members, store, run)
        assert rows(hash_match_counts(read_daily_counts(df, store, run))) == rows(
            hash_match_counts(lookback(df, run), members)
        )
    # The first run date again, now with days in the store that lie after it.
    assert rows(hash_match_counts(read_daily_counts(df, store, RUN))) == rows(
        hash_match_counts(lookback(df, RUN), members)
    )


def test_refresh_computes_only_missing_days_unless_told(spark, emails, tmp_path):
    members, store = audience_members(emails), str(tmp_path / "store")
    refresh_daily_counts(impressions(spark, DATA), members, store, RUN, max_days=31)
    late = impressions(spark, [*DATA, seen("a", 1), seen("b", 2)])
    computed = refresh_daily_counts(late, members, store, RUN, max_days=31)
    assert computed == []
    assert rows(hash_match_counts(read_daily_counts(late, store, RUN, max_days=31))) == [("a", 3, 4, 4)]
    refresh_daily_counts(late, members, store, RUN, max_days=31, redo=[RUN - timedelta(days=n) for n in (1, 2)])
    assert rows(hash_match_counts(read_daily_counts(late, store, RUN, max_days=31))) == [("a", 4, 5, 5), ("b", 1, 1, 1)]


def test_a_day_computed_again_without_matches_is_emptied(spark, emails, tmp_path):
    members, store, day = audience_members(emails), str(tmp_path / "store"), RUN - timedelta(days=1)
    refresh_daily_counts(impressions(spark, [*DATA, seen("a", 1)]), members, store, RUN, max_days=31)
    changed = impressions(spark, DATA).filter(F.col("date_p") != F.lit(day))
    refresh_daily_counts(changed, members, store, RUN, max_days=31, redo=[day])
    assert rows(hash_match_counts(read_daily_counts(changed, store, RUN, max_days=31))) == rows(
        hash_match_counts(lookback(changed, RUN, 31), members)
    )


@pytest.mark.parametrize("kept", [False, True])
def test_run_writes_three_results(spark, emails, tmp_path, kept):
    df = impressions(spark, DATA)
    store = str(tmp_path / "store") if kept else None
    for _ in range(2):
        audience_run(df, emails, str(tmp_path / "out"), RUN, store=store, max_files=2)
    results = {
        name: spark.read.csv(str(tmp_path / "out" / name))
        for name in ("hash_match_counts", "user_agent_counts", "category_counts")
    }
    assert rows(results["hash_match_counts"]) == [("a", "3", "6", "7"), ("b", None, None, None)]
    assert results["user_agent_counts"].count() == 1
    assert results["category_counts"].count() == 3


def test_store_without_any_match(spark, emails, tmp_path):
    df, store = impressions(spark, [seen("x", 1)]), str(tmp_path / "store")
    for _ in range(2):
        refresh_daily_counts(df, audience_members(emails), store, RUN)
        assert rows(hash_match_counts(read_daily_counts(df, store, RUN))) == []
