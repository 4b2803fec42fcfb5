"""Plans that have to hold on large data: what is shuffled, what is pruned, what a hot key does."""

from __future__ import annotations

import re
from datetime import date

import __spark_entry__ as registered
import pytest
from pyspark.sql import functions as F

from hemtally.operators import (
    audience_impressions,
    audience_members,
    category_counts,
    cluster_report,
    convert_hashes,
    cookies_to_hashes,
    daily_counts,
    explode_clusters,
    hash_match_counts,
    hashes_of_cookies,
    lookback,
    match_counts,
    match_flags,
    matched_counts,
    pair_stats,
    pids_per_cluster,
    user_agent_counts,
)
from hemtally.operators.audience import USER_AGENT, flat_impressions
from helpers import plan, rows

FOLDER = "/root/testdata/sf0.001"
RUN = date(2024, 7, 1)


# Queries of the training-data package, where it is present, have tests of their own.
OWN = sorted(name for name in registered.queries() if not re.match(r"op\d+_|pipeline$", name))


@pytest.mark.parametrize("name", OWN)
def test_no_query_leaves_the_jvm_or_pairs_every_row(spark, name):
    text = plan(registered.queries()[name](spark, FOLDER))
    for operator in ("EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """60,000 rows a third of which share one key, and a list of keys a third of which are that key."""
    folder = tmp_path_factory.mktemp("skewed")
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7000).cast("string"))
    (
        spark.range(0, 60000, 1, 8)
        .select(
            F.md5(key).alias("md5"),
            F.struct(F.md5(F.col("id").cast("string")).alias("ip"), F.lit("unused").alias("agent")).alias("request"),
            *(F.lit(c).alias(c) for c in ("dev_type", "dev_maker", "nbrowser", "os", "category_id")),
            F.md5((F.col("id") % 9000).cast("string")).alias("other"),
            F.date_sub(F.lit(RUN), (F.col("id") % 200).cast("int")).alias("date_p"),
        )
        .write.parquet(str(folder / "rows"))
    )
    listed = spark.range(0, 3000, 1, 4).select(F.md5((F.col("id") * 2).cast("string")).alias("key"))
    hot = spark.range(0, 1500, 1, 4).select(F.md5(F.lit("hot")).alias("key"))
    listed.union(hot).write.parquet(str(folder / "keys"))
    return spark.read.parquet(str(folder / "rows")), spark.read.parquet(str(folder / "keys"))


@pytest.fixture
def large_joins(conf):
    """Joins as on data of any size: shuffled, and split when a partition stands out."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__shuffle__partitions="16",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="40k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    )


def raw_semi_joins(skewed):
    data, keys = skewed
    old = F.lit("20240101").alias("date_p")
    lookup = data.select(F.col("md5").alias("sh1"), F.col("other").alias("md5"), old)
    graph = data.select(F.col("md5").alias("cookie"), F.col("other").alias("hash"), old)
    emails = keys.select(F.col("key").alias("md5"), old)
    return {
        "convert_hashes": convert_hashes(keys.select(F.col("key").alias("sh1")), lookup, "sha1", "20240101"),
        "hashes_of_cookies": hashes_of_cookies(keys.select(F.col("key").alias("cookie")), graph, "20240101"),
        "audience_impressions": audience_impressions(data, emails, RUN, snapshot="20240101"),
        "user_agent_counts": user_agent_counts(flat_impressions(lookback(data, RUN)), audience_members(emails, "20240101")),
        # rows of equal texts would compress to a few KB
        "category_counts": category_counts(lookback(data, RUN).withColumn("category_id", F.col("other")), audience_members(emails, "20240101")),
        "daily_counts": daily_counts(flat_impressions(lookback(data, RUN)), USER_AGENT, audience_members(emails, "20240101")),
        "matched_counts": matched_counts(flat_impressions(lookback(data, RUN)), audience_members(emails, "20240101")),
    }


@pytest.mark.parametrize(
    "name",
    [
        "convert_hashes",
        "hashes_of_cookies",
        "audience_impressions",
        "user_agent_counts",
        "category_counts",
        "daily_counts",
        "matched_counts",
    ],
)
def test_a_hot_key_is_split_and_nothing_is_lost(spark, skewed, conf, large_joins, name):
    split = raw_semi_joins(skewed)[name]
    assert "SortMergeJoin(skew=true)" in plan(split)
    shuffled = rows(split)
    conf(spark__sql__autoBroadcastJoinThreshold="10m")
    whole = raw_semi_joins(skewed)[name]
    assert "BroadcastHashJoin" in plan(whole)
    assert rows(whole) == shuffled


def test_counting_by_hash_shuffles_impressions_once(spark, skewed, large_joins):
    data, keys = skewed
    members = keys.select(F.col("key").alias("md5"))
    text = plan(hash_match_counts(lookback(data, RUN), members))
    # One exchange for the impressions, already combined, and one for the list.
    assert text.count(" Exchange hashpartitioning") == 2
    assert text.index("SortMergeJoin") < text.index("partial_sum")


def test_a_short_list_is_applied_before_anything_is_shuffled(spark, skewed):
    data, keys = skewed
    members = keys.select(F.col("key").alias("md5"))
    pairs = data.select(
        F.col("md5").alias("hem"), F.lit("100").alias("domain"), F.lit("US").alias("region"), F.lit("1").alias("date_p")
    )
    client = keys.select(F.col("key").alias("hem"))
    graph = data.select(
        F.col("md5").alias("hash"), F.lit("x").alias("identifier"), F.lit("1").alias("date_p")
    )
    for query in (
        hash_match_counts(lookback(data, RUN), members),
        match_counts(pair_stats(pairs, "1"), client),
        match_flags(client, graph, pairs.withColumn("domain", F.lit("aaid")), "1", "1"),
    ):
        below = plan(query).split("LeftSemi")[1:]
        assert below
        # From each semi join down to the large table's scan.
        assert all("Exchange" not in part[: part.index("FileScan")] for part in below)


def test_cluster_report_reads_the_file_once_and_joins_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "aaid:1|7:2"), (2, "idfa:1")], "id long, tokens string").write.parquet(str(tmp_path / "c"))
    long = explode_clusters(spark.read.parquet(str(tmp_path / "c")), "id", "tokens")
    text = plan(cluster_report(long))
    assert text.count("FileScan") == 1
    assert "Join" not in text
    assert text.count(" Exchange ") == 5
    # Sketches come from the same shuffled sizes as the other measures.
    text = plan(pids_per_cluster(long, accuracy=100))
    assert text.count("FileScan") == 1
    assert "ReusedExchange" in text


@pytest.fixture(scope="module")
def by_day(spark, skewed, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("days") / "t")
    skewed[0].repartition("date_p").write.partitionBy("date_p").parquet(folder)
    return spark.read.parquet(folder)


def test_lookback_reads_its_days_and_columns_only(spark, by_day):
    text = plan(user_agent_counts(flat_impressions(lookback(by_day, RUN, 2))))
    filters = text[text.index("PartitionFilters") :]
    assert filters.startswith("PartitionFilters: [date_p") or filters.startswith("PartitionFilters: [isnotnull(date_p")
    assert "IN (2024-06-29,2024-06-30)" in filters[: filters.index("PushedFilters")]
    assert "request:struct<ip:string>" in text
    assert "category_id" not in text


def test_default_log_window_prunes_days(spark, tmp_path):
    cookie = F.col("id").cast("string")
    (
        spark.range(100)
        .select(
            F.lit("1").alias("adv_id"),
            cookie.alias("linked_cookie"),
            cookie.alias("domain_user_id"),
            F.date_sub(F.lit(RUN), (F.col("id") % 20).cast("int")).alias("log_date"),
        )
        .write.partitionBy("log_date")
        .parquet(str(tmp_path / "log"))
    )
    graph = spark.createDataFrame([("h", "1", "20240630")], "hash string, cookie string, date_p string")
    result = cookies_to_hashes(spark.read.parquet(str(tmp_path / "log")), graph, "1")
    scan = next(line for line in plan(result).splitlines() if "FileScan parquet" in line)
    assert "PartitionFilters: [isnotnull(log_date" in scan and "Subquery" in scan
    assert rows(result) == [("h",)]


def test_a_run_reads_and_meets_the_impressions_once(spark, skewed, large_joins):
    data, keys = skewed
    members = keys.select(F.col("key").alias("md5"))
    text = plan(matched_counts(flat_impressions(lookback(data, RUN)), members))
    assert text.count("FileScan") == 2 and text.count("SortMergeJoin") == 1


def test_days_kept_as_text_are_pruned(spark, by_day, tmp_path):
    by_day.withColumn("date_p", F.date_format("date_p", "yyyyMMdd")).write.partitionBy("date_p").parquet(str(tmp_path / "t"))
    text_days = spark.read.schema(by_day.withColumn("date_p", F.lit("")).schema).parquet(str(tmp_path / "t"))
    recent = user_agent_counts(flat_impressions(lookback(text_days, RUN, 2)))
    assert rows(recent) == rows(user_agent_counts(flat_impressions(lookback(by_day, RUN, 2)))) != []
    assert "PartitionFilters: [date_p" in plan(recent) and "IN (20240629,20240630)" in plan(recent)
