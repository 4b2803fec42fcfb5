from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from hemtally.functions.dates import between_days, day_value, on_days
from hemtally.plans import catalog_pair_stats, deliver_cookie_hashes
from hemtally.sources import (
    at_snapshot,
    day_paths,
    latest_partition,
    latest_snapshot,
    latest_value,
    malformed_lines,
    malformed_rows,
    present_paths,
    query_rows,
    read_delimited,
    shared_path,
)
from helpers import plan, rows


def test_explicit_columns_all_strings(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\tx\t\n2\t\tz\n\n3\ty\tw\n")
    df = read_delimited(spark, str(tmp_path / "a.tsv"), ["k", "v", "w"])
    assert [f.dataType.simpleString() for f in df.schema] == ["string"] * 3
    assert rows(df) == [("1", "x", None), ("2", None, "z"), ("3", "y", "w")]


def test_many_paths_and_wildcards(spark, tmp_path):
    for name in ("a1", "a2", "b1"):
        (tmp_path / name).write_text(f"{name}\n")
    assert rows(read_delimited(spark, str(tmp_path / "a*"), ["k"], sep=",")) == [("a1",), ("a2",)]
    assert rows(read_delimited(spark, [str(tmp_path / "a1"), str(tmp_path / "b1")], ["k"])) == [("a1",), ("b1",)]


def test_lines_with_a_wrong_number_of_fields_are_counted(spark, tmp_path):
    (tmp_path / "f").write_text("1,x\n2\n3,y,z\n4,w\n")
    df = read_delimited(spark, str(tmp_path / "f"), ["k", "v"], sep=",", malformed="bad")
    assert rows(malformed_rows(df, "bad")) == [(4, 2)]


def test_day_paths_include_both_ends():
    assert day_paths("s3://log/", "20240131", date(2024, 2, 1)) == ["s3://log/2024/01/31/*/", "s3://log/2024/02/01/*/"]


@pytest.fixture
def table(spark, tmp_path):
    df = spark.range(300).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "20240201").otherwise("20240101").alias("date_p")
    )
    df.write.partitionBy("date_p").parquet(str(tmp_path / "t"))
    return spark.read.schema("id long, date_p string").parquet(str(tmp_path / "t"))


def test_newest_snapshot_reads_only_its_partition(table):
    newest = latest_snapshot(table)
    assert newest.count() == 100
    text = plan(newest)
    assert "PartitionFilters: [isnotnull(date_p" in text and "Subquery" in text


def test_given_snapshot_is_pruned_while_planning(table):
    assert at_snapshot(table, "20240101").count() == 200
    assert "= 20240101)]" in plan(at_snapshot(table, "20240101"))
    assert latest_value(table) == "20240201"


def test_newest_partition_from_the_catalog_skips_empty_ones(spark, table):
    spark.sql("drop table if exists snapshots")
    table.write.partitionBy("date_p").saveAsTable("snapshots")
    try:
        assert latest_partition(spark, "snapshots") == "20240201"
        spark.sql("alter table snapshots add partition (date_p = '20240301')")
        assert latest_partition(spark, "snapshots") == "20240201"
        assert query_rows(spark, "select count(*) from snapshots").first()[0] == 300
    finally:
        spark.sql("drop table snapshots")


def test_path_lies_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert shared_path(spark, "x").startswith(f"{shared}/x-")
    assert shared_path(spark, "x") != shared_path(spark, "x")


def test_days_as_text_are_compared_in_their_own_format(spark):
    days = [date(2024, 1, 31), date(2024, 2, 1)]
    for values in (["2024-01-30", "2024-01-31", "2024-02-01", None], ["20240130", "20240131", "20240201", None]):
        df = spark.createDataFrame([(v,) for v in values], "day string")
        assert df.filter(on_days(df, "day", days)).count() == 2
        assert df.filter(between_days(df, "day", *(F.lit(d) for d in days))).count() == 2
        assert [r[0] for r in df.select(day_value(df, "day")).collect()] == [date(2024, 1, 30), *days, None]
    odd = spark.createDataFrame([(None,), ("01/31/2024",)], "day string")
    with pytest.raises(ValueError, match="01/31/2024"):
        on_days(odd, "day", days)
    with pytest.raises(TypeError):
        on_days(spark.range(1), "id", days)
    assert odd.limit(0).filter(on_days(odd.limit(0), "day", days)).count() == 0


def test_lines_by_their_number_of_fields(spark, tmp_path):
    (tmp_path / "f").write_text("a\tb\nc\n\td\ne\tf\tg\nb\n")
    df = read_delimited(spark, str(tmp_path / "f"), ["x", "y"], malformed="line")
    assert sorted(map(tuple, malformed_lines(df, "line").collect())) == [(1, 2, "b"), (3, 1, "e\tf\tg")]


def test_days_without_a_log_are_passed_over(spark, tmp_path):
    fields = [f"f{n}" for n in range(24)]
    fields[23], fields[6], fields[8] = "7", "cookie", "null"
    for day in ("2024/01/30/05", "2024/01/28/00"):
        (tmp_path / "log" / day).mkdir(parents=True)
        (tmp_path / "log" / day / "part").write_text("\t".join(fields) + "\n")
    paths = day_paths(str(tmp_path / "log"), "2024-01-27", "2024-01-30")
    assert present_paths(spark, paths) == ([paths[1], paths[3]], [paths[0], paths[2]])
    graph = spark.createDataFrame([("hash", "cookie", "20240130")], "hash string, cookie string, date_p string")
    for most in (None, 5):
        out = deliver_cookie_hashes(spark, str(tmp_path / "log"), graph, "7", str(tmp_path / f"out{most}"), most_missing=most)
        assert [tuple(r) for r in spark.read.csv(out).collect()] == [("hash",)] and list((tmp_path / f"out{most}" / "20240130").glob("*.gz"))
    for options in ({"most_missing": 4}, {"start": "2023-01-01", "end": "2023-01-02"}):
        with pytest.raises(FileNotFoundError):
            deliver_cookie_hashes(spark, str(tmp_path / "log"), graph, "7", str(tmp_path / "none"), **options)


def test_the_catalog_names_the_one_partition_that_is_opened(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "1", "US", "20240101"), ("b", "1", "EU", "20240201")], "hem string, domain string, region string, date_p string")
    pairs.write.partitionBy("date_p").option("path", str(tmp_path / "pairs")).saveAsTable("catalog_pairs")
    try:
        stats = catalog_pair_stats(spark, "catalog_pairs")
        assert [tuple(r) for r in stats.collect()] == [("b", "1", 1, 0)]
        assert "= 20240201)]" in plan(stats) and [f.rsplit("/", 2)[1] for f in stats.inputFiles()] == ["date_p=20240201"]
    finally:
        spark.sql("drop table catalog_pairs")
