from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hemtally.operators import (
    check_cluster_file,
    check_column_count,
    cluster_report,
    clusters_per_pid,
    explode_clusters,
    pids_per_cluster,
)
from hemtally.operators.clusters import FIVE_POINTS, PERCENTILES
from helpers import by_key, rows

NAMES = ("min", "p25", "p50", "p75", "p85", "p90", "p95", "max")


def clusters(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "id long, tokens string")


def long_form(spark, lists):
    return explode_clusters(clusters(spark, lists), "id", "tokens")


def expected(lists, by_pid=False):
    """The distributions by plain counting."""
    sizes = Counter()
    for cluster, tokens in enumerate(lists):
        for token in [] if tokens is None else tokens.split("|"):
            sizes[(token if by_pid else cluster, token.split(":", 1)[0])] += 1
    labelled = defaultdict(list)
    for (key, domain), ct in sizes.items():
        labelled["ALL"].append((key, ct))
        labelled[domain].append((key, ct))
        if domain in ("aaid", "idfa"):
            labelled["MAID ALL"].append((key, ct))
    if not {"aaid", "idfa"} <= {domain for _, domain in sizes}:
        labelled.pop("MAID ALL", None)
    report = {}
    for label, groups in labelled.items():
        values = sorted(ct for _, ct in groups)
        n = len({key for key, _ in groups}) if label in ("ALL", "MAID ALL") else len(groups)
        picks = [values[max(math.ceil(Decimal(str(p)) * len(values)), 1) - 1] for p in PERCENTILES]
        report[label] = (n, sum(values) / len(values), *picks)
    return report


def measured(df):
    return {
        label: (row["ct"], row["mean"], *(row[name] for name in NAMES)) for label, row in by_key(df, "domain").items()
    }


def assert_same(actual, wanted):
    assert actual.keys() == wanted.keys()
    for label, row in wanted.items():
        assert actual[label][0] == row[0], label
        assert actual[label][1] == pytest.approx(row[1], abs=0.0500001), label
        assert actual[label][2:] == row[2:], label


def test_long_form_of_odd_lists(spark):
    df = long_form(spark, ["aaid:1|7:2", "plain", ":x", "idfa:3|", None, "", "a:b:c"])
    assert rows(df) == [
        (0, "7:2", "7"),
        (0, "aaid:1", "aaid"),
        (1, "plain", "plain"),
        (2, ":x", ""),
        (3, "", ""),
        (3, "idfa:3", "idfa"),
        (5, "", ""),
        (6, "a:b:c", "a"),
    ]


def test_check_looks_at_every_row(spark):
    df = clusters(spark, ["7:1", "idfa:2|junk", "aaid:3", "junk:1", None, "", "x7:1"])
    assert rows(check_cluster_file(df, "tokens")) == [(7, 4, False)]
    assert rows(check_cluster_file(clusters(spark, ["7:1"]), "tokens")) == [(1, 0, True)]
    assert rows(check_cluster_file(df.limit(0), "tokens")) == [(0, 0, False)]


def test_older_check_counts_columns(spark):
    check_column_count(clusters(spark, ["7:1"]))
    with pytest.raises(ValueError):
        check_column_count(spark.range(1))


def test_repeated_token_counts_twice_and_totals_count_clusters_once(spark):
    lists = ["aaid:1|aaid:1|7:2", "7:2", "idfa:3"]
    assert_same(measured(pids_per_cluster(long_form(spark, lists))), expected(lists))
    assert measured(pids_per_cluster(long_form(spark, lists)))["ALL"][:2] == (3, 1.3)


def test_no_mobile_total_unless_both_domains_occur(spark):
    for lists, has in ((["aaid:1|7:2"], False), (["aaid:1", "idfa:2"], True), (["7:1"], False)):
        for operator in (pids_per_cluster, clusters_per_pid):
            assert ("MAID ALL" in measured(operator(long_form(spark, lists)))) is has


def test_empty_file_has_no_rows(spark):
    empty = long_form(spark, ["7:1"]).limit(0)
    for operator in (pids_per_cluster, clusters_per_pid, cluster_report):
        assert rows(operator(empty)) == []


def test_domain_that_is_spelt_like_a_total_stays_apart(spark):
    labels = [domain for domain, *_ in rows(pids_per_cluster(long_form(spark, ["ALL:1|7:2"])))]
    assert labels == ["7", "ALL", "ALL"]


def test_null_cluster_id_is_not_a_cluster(spark):
    df = spark.createDataFrame([(None, "7:1"), (1, "7:1|7:2")], "id long, tokens string")
    result = measured(pids_per_cluster(explode_clusters(df, "id", "tokens")))
    assert result["ALL"][0] == 1
    assert result["7"][0] == 2


def test_five_point_form(spark):
    df = pids_per_cluster(long_form(spark, ["7:1|7:2", "7:1"]), FIVE_POINTS)
    assert df.columns == ["domain", "ct", "mean", "min", "p25", "p50", "p75", "max"]


def test_report_puts_both_sides_together(spark):
    lists = ["aaid:1|aaid:1|7:2", "7:2|idfa:4", "idfa:3", None]
    report = by_key(cluster_report(long_form(spark, lists)), "domain")
    for side, wanted in (("cluster", expected(lists)), ("pid", expected(lists, by_pid=True))):
        actual = {
            label: (row[f"{side}_ct"], row[f"{side}_mean"], *(row[f"{side}_{name}"] for name in NAMES))
            for label, row in report.items()
        }
        assert_same(actual, wanted)


token = st.builds("{}:{}".format, st.sampled_from(["aaid", "idfa", "7", "8"]), st.integers(0, 6))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.lists(token, min_size=1, max_size=12).map("|".join)), min_size=1, max_size=30))
def test_distributions_match_plain_counting(spark, lists):
    df = long_form(spark, lists)
    assert_same(measured(pids_per_cluster(df)), expected(lists))
    assert_same(measured(clusters_per_pid(df)), expected(lists, by_pid=True))


def test_sketch_stays_within_its_rank_error(spark):
    chance = random.Random(5)
    lists = ["|".join(f"7:{n}" for n in range(int(chance.paretovariate(0.7)) % 3000 + 1)) for _ in range(3000)]
    sizes = sorted(text.count("|") + 1 for text in lists)
    sketched = measured(pids_per_cluster(long_form(spark, lists), accuracy=100))
    exact = measured(pids_per_cluster(long_form(spark, lists)))
    assert sketched["ALL"][:2] == exact["ALL"][:2]
    for p, value in zip(PERCENTILES, sketched["7"][2:]):
        below = sum(size < value for size in sizes) / len(sizes)
        upto = sum(size <= value for size in sizes) / len(sizes)
        assert below - 0.0101 <= p <= upto + 0.0101


@pytest.mark.parametrize("digits", [1, 3, 12])
def test_summaries_certify_how_far_their_ranks_are_off(spark, digits):
    r = random.Random(digits)
    lists = ["|".join(f"{r.choice(['7', 'aaid', 'idfa'])}:{r.randrange(10**6)}" for _ in range(int(r.paretovariate(0.7)) % 900 + 1)) for _ in range(150)]
    exact = by_key(pids_per_cluster(long_form(spark, lists)), "domain")
    summary = by_key(pids_per_cluster(long_form(spark, lists).repartition(7), digits=digits), "domain")
    sizes = defaultdict(list)
    for tokens in lists:
        for domain, n in Counter(token.split(":")[0] for token in tokens.split("|")).items():
            sizes[domain].append(n)
    assert summary.keys() == exact.keys()
    for domain, row in summary.items():
        assert (row["ct"], row["mean"]) == (exact[domain]["ct"], exact[domain]["mean"])
        groups = sizes[domain] if domain in sizes else [n for d in sizes for n in sizes[d] if domain == "ALL" or d != "7"]
        for name in NAMES:
            low, high = exact[domain][name], row[name]
            assert low <= high < low * (1 + 2 ** (1 - digits)) + 1
            assert sum(low <= n < high for n in groups) <= round(row["rank_error"] * len(groups)) + 1
        assert digits < 12 or (row["rank_error"], [row[n] for n in NAMES]) == (0, [exact[domain][n] for n in NAMES])
