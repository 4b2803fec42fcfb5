from __future__ import annotations

import pytest

from hemtally.operators import domain_breakdown, match_counts, match_flags, pair_stats
from helpers import rows

LIDID = "0123abcd-0123-abcd-0123-0123456789ab"


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(
        [
            ("h1", "aaid", "US", "20240201"),
            ("h1", "aaid", "EU", "20240201"),
            ("h1", "100", None, "20240201"),
            ("h2", "100", "EU", "20240201"),
            ("h3", "100", "US", "20240201"),
            ("h3", "200", "US", "20240201"),
            ("h9", "idfa", "US", "20240101"),
            (None, "100", "US", "20240201"),
        ],
        "hem string, domain string, region string, date_p string",
    )


def hems(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "hem string")


def test_pair_stats_of_the_newest_snapshot(pairs):
    assert rows(pair_stats(pairs)) == [
        ("h1", "100", 1, 0),
        ("h1", "aaid", 2, 1),
        ("h2", "100", 1, 0),
        ("h3", "100", 1, 1),
        ("h3", "200", 1, 1),
        (None, "100", 1, 1),
    ]


def test_pair_stats_of_a_given_snapshot_and_region(pairs):
    assert rows(pair_stats(pairs, "20240101", region="EU")) == [("h9", "idfa", 1, 0)]


def test_match_counts_ignore_copies_and_nulls(spark, pairs):
    client = hems(spark, "h1", "h1", "h2", "h8", None)
    assert rows(match_counts(pair_stats(pairs), client)) == [(2, 1)]


def test_match_counts_without_a_match(spark, pairs):
    assert rows(match_counts(pair_stats(pairs), hems(spark, "h8"))) == [(0, 0)]


@pytest.fixture
def names(spark):
    return spark.createDataFrame([(100, "News"), (300, "Unseen")], "id long, name string")


def test_breakdown_multiplies_pairs_by_copies(spark, pairs, names):
    client = hems(spark, "h1", "h3", "h3", None)
    stats = pair_stats(pairs)
    assert [tuple(row) for row in domain_breakdown(stats, client, names).collect()] == [
        ("100", "News", 1, 2),
        ("200", None, 1, 2),
        ("aaid", None, 1, 1),
    ]
    assert [tuple(row) for row in domain_breakdown(stats, client, names, dedupe_client=True).collect()] == [
        ("100", "News", 1, 1),
        ("200", None, 1, 1),
        ("aaid", None, 1, 1),
    ]


def test_breakdown_keeps_the_first_n_by_pairs_then_domain(spark, pairs, names):
    client = hems(spark, "h1", "h3", "h3")
    assert [row.domain for row in domain_breakdown(pair_stats(pairs), client, names, n=2).collect()] == ["100", "200"]


def test_breakdown_of_names_listed_twice(spark, pairs):
    twice = spark.createDataFrame([("100", "News"), ("100", "News"), ("100", "Old")], "id string, name string")
    result = domain_breakdown(pair_stats(pairs), hems(spark, "h3"), twice)
    assert rows(result) == [("100", "News", 1, 2), ("100", "Old", 1, 1), ("200", None, 1, 1)]


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_same_results_with_and_without_broadcast(spark, pairs, names, conf, threshold):
    conf(spark__sql__autoBroadcastJoinThreshold=threshold)
    client = hems(spark, "h1", "h3", "h3", None)
    assert rows(match_counts(pair_stats(pairs), client)) == [(2, 2)]
    assert rows(domain_breakdown(pair_stats(pairs), client, names)) == [
        ("100", "News", 1, 2),
        ("200", None, 1, 2),
        ("aaid", None, 1, 1),
    ]


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_flags(spark, pairs, conf, threshold):
    conf(spark__sql__autoBroadcastJoinThreshold=threshold)
    graph = spark.createDataFrame(
        [
            ("h1", LIDID, "20240130"),
            ("h1", LIDID, "20240130"),
            ("h2", "x" + LIDID, "20240130"),
            ("h3", LIDID.upper(), "20240130"),
            ("h4", LIDID, "20240101"),
            (None, LIDID, "20240130"),
        ],
        "hash string, identifier string, date_p string",
    )
    client = hems(spark, "h1", "h1", "h2", "h3", "h4", "h9", None, None)
    assert rows(match_flags(client, graph, pairs)) == [
        ("h1", True, True),
        ("h2", False, False),
        ("h3", False, False),
        ("h4", False, False),
        ("h9", False, False),
        (None, False, False),
    ]
    assert ("h9", False, True) in rows(match_flags(client, graph, pairs, "20240101", "20240101"))
