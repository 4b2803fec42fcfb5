from __future__ import annotations

from datetime import date
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException

from hemtally.operators import match_flags
from hemtally.plans import cluster_file_report, converted_hashes, daily_load, file_report, stat_report, write_match_file
from hemtally.sinks import load_snapshot, write_dated_csv, write_delimited
from helpers import rows

RUN = "2024-01-31"
DAY, BEFORE = date(2024, 1, 30), date(2024, 1, 29)


def kept(spark, *data):
    return spark.createDataFrame(list(data), "k string, event_date date")


def test_load_dates_drops_copies_and_replaces_the_day(spark, tmp_path):
    target = str(tmp_path / "t")
    load_snapshot(kept(spark, ("old", DAY), ("old", BEFORE), ("old", BEFORE)), target, RUN)
    incoming = spark.createDataFrame([("new",), ("new",), (None,), (None,)], "k string")
    for _ in range(2):
        load_snapshot(incoming, target, RUN)
        assert rows(spark.read.parquet(target)) == [("new", DAY), ("old", BEFORE), (None, DAY)]


def test_load_replaces_every_day_it_brings(spark, tmp_path):
    target = str(tmp_path / "t")
    load_snapshot(kept(spark, ("old", DAY), ("old", BEFORE), ("old", date(2024, 1, 1))), target, RUN)
    for _ in range(2):
        load_snapshot(kept(spark, ("new", DAY), ("new", BEFORE)), target, RUN)
    assert rows(spark.read.parquet(target)) == [("new", BEFORE), ("new", DAY), ("old", date(2024, 1, 1))]


def test_load_without_rows_for_the_day_empties_it(spark, tmp_path):
    target = str(tmp_path / "t")
    load_snapshot(kept(spark, ("old", DAY), ("old", BEFORE)), target, RUN)
    load_snapshot(spark.createDataFrame([], "k string"), target, RUN)
    assert rows(spark.read.parquet(target)) == [("old", BEFORE)]
    load_snapshot(kept(spark, ("new", BEFORE)), target, RUN)
    assert rows(spark.read.parquet(target)) == [("new", BEFORE)]


def test_dated_csv_has_a_header_and_refuses_a_file_type(spark, tmp_path):
    path = write_dated_csv(spark.range(2), str(tmp_path), "job", RUN)
    assert path == f"{tmp_path}/job_2024-01-30"
    assert rows(spark.read.option("header", True).csv(path)) == [("0",), ("1",)]
    with pytest.raises(ValueError):
        write_dated_csv(spark.range(2), str(tmp_path), "job.csv", RUN)


def test_daily_load_keeps_a_csv_and_loads_the_same_rows(spark, tmp_path):
    result = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("", 3), (None, 3), ('x\n"y', 4)], "k string, n int")
    for _ in range(2):
        path = daily_load(result, "job", str(tmp_path / "csv"), str(tmp_path / "t"), RUN)
    loaded = rows(spark.read.parquet(str(tmp_path / "t")))
    assert loaded == [("", 3, DAY), ("a", 1, DAY), ("b", 2, DAY), ('x\n"y', 4, DAY), (None, 3, DAY)]
    text = spark.read.option("header", True).option("multiLine", True).csv(path)
    assert rows(text.filter("n < 3")) == [("a", "1", "2024-01-30"), ("b", "2", "2024-01-30")]
    assert text.count() == 5


def test_file_count_is_capped(spark, tmp_path):
    write_delimited(spark.range(1000).repartition(6), str(tmp_path / "o"), max_files=2)
    assert len(list(Path(tmp_path / "o").glob("part-*"))) == 2
    assert spark.read.csv(str(tmp_path / "o")).count() == 1000


LINKED = "0123abcd-0123-abcd-0123-0123456789ab"


@pytest.fixture
def tables(spark):
    return {
        "pairs": spark.createDataFrame(
            [("a" * 32, "aaid", "US", "20240201"), ("b" * 32, "100", "EU", "20240201")],
            "hem string, domain string, region string, date_p string",
        ),
        "graph": spark.createDataFrame(
            [("b" * 32, LINKED, "20240130")], "hash string, identifier string, date_p string"
        ),
        "names": spark.createDataFrame([("100", "News")], "id string, name string"),
        "lookup": spark.createDataFrame(
            [("a" * 32, "1" * 40, "2" * 64, "20240101")], "md5 string, sh1 string, sh2 string, date_p string"
        ),
    }


def test_match_file_is_named_after_both_snapshots_and_never_replaced(spark, tables, tmp_path):
    client = spark.createDataFrame([("a" * 32,), ("b" * 32,)], "hem string")
    path = write_match_file(client, tables["graph"], tables["pairs"], str(tmp_path))
    assert path.endswith("/L20240130M20240201")
    assert rows(spark.read.csv(path)) == [("a" * 32, "false", "true"), ("b" * 32, "true", "false")]
    assert match_flags(client, tables["graph"], tables["pairs"]).count() == 2
    with pytest.raises(AnalysisException):
        write_match_file(client, tables["graph"], tables["pairs"], str(tmp_path))


def test_statistics_of_a_converted_file(spark, tables, tmp_path):
    (tmp_path / "client").write_text("1" * 40 + "\n" + "9" * 40 + "\n")
    out = str(tmp_path / "md5")
    for _ in range(2):
        converted = converted_hashes(spark, str(tmp_path / "client"), "sha1", tables["lookup"], out)
    original = spark.read.schema("hem string").csv(str(tmp_path / "client"))
    report = stat_report(original, tables["pairs"], tables["names"], converted)
    assert rows(report["hash_types"]) == [("sh1", 2, 2)]
    assert rows(report["hash_types_converted"]) == [("md5", 1, 1)]
    assert rows(report["match_counts"]) == [(1, 1)]
    assert rows(report["domain_breakdown"]) == [("aaid", None, 1, 1)]
    with pytest.raises(ValueError):
        converted_hashes(spark, str(tmp_path / "client"), "sha512", tables["lookup"], out)


def test_reports_on_files(spark, tmp_path):
    (tmp_path / "f").write_text("1\taaid:1|idfa:2\n2\t7:1|7:1\n3\n")
    report = file_report(spark, str(tmp_path / "f"), ["id", "tokens"])
    assert rows(report["profile"]) == [("id", 3, 3), ("tokens", 3, 2)]
    assert rows(report["malformed"]) == [(3, 1)]
    clusters = cluster_file_report(spark, str(tmp_path / "f"), ["id", "tokens"])
    assert rows(clusters["check"]) == [(3, 1, False)]
    assert rows(clusters["distribution"], "domain", "cluster_ct", "pid_ct", "pid_max") == [
        ("7", 1, 1, 2),
        ("ALL", 2, 3, 2),
        ("MAID ALL", 1, 2, 1),
        ("aaid", 1, 1, 1),
        ("idfa", 1, 1, 1),
    ]
