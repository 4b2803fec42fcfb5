from __future__ import annotations

from datetime import date

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from hemtally.sinks import DayTable
from helpers import rows

RUN, DAY, BEFORE = date(2024, 1, 31), date(2024, 1, 30), date(2024, 1, 29)


def kept(spark, *values):
    return spark.createDataFrame(list(values), "k string, event_date date")


@pytest.fixture
def table(spark, tmp_path):
    return DayTable(spark, str(tmp_path / "t"))


def test_a_load_replaces_its_days_and_the_day_before_the_run(spark, table):
    assert table.load(kept(spark, ("old", DAY), ("old", BEFORE), ("old", BEFORE)), RUN) == 1
    assert rows(table.read()) == [("old", BEFORE), ("old", DAY)]
    table.load(spark.createDataFrame([("new",)], "k string"), RUN)
    assert rows(table.read()) == [("new", DAY), ("old", BEFORE)]
    table.load(kept(spark, ("newer", BEFORE)), RUN)
    assert rows(table.read()) == [("newer", BEFORE)] and rows(table.read(1)) == [("old", BEFORE), ("old", DAY)]
    table.load(kept(spark), "2024-01-30")
    assert table.read().collect() == [] and table.read().columns == ["k", "event_date"]


def test_a_load_that_fails_before_its_commit_changes_nothing(spark, table, monkeypatch):
    table.load(kept(spark, ("old", DAY), ("old", BEFORE)), RUN)
    before = rows(table.read())

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(DayTable, "_commit", fail)
        with pytest.raises(RuntimeError):
            table.load(kept(spark, ("new", BEFORE)), RUN)
    assert rows(table.read()) == before and table.newest()[0] == 1
    broken = kept(spark, ("new", BEFORE)).withColumn("k", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        table.load(broken, RUN)
    assert rows(table.read()) == before
    table.load(kept(spark, ("new", BEFORE)), RUN)
    assert rows(table.read()) == [("new", BEFORE)]
    assert table.vacuum() > 0 and rows(table.read()) == [("new", BEFORE)] and table.vacuum() == 0


def test_of_two_loads_from_one_version_the_second_fails(spark, table, monkeypatch):
    table.load(kept(spark, ("old", DAY)), RUN)
    seen = table.newest()
    table.load(kept(spark, ("first", DAY)), RUN)
    with monkeypatch.context() as m:
        m.setattr(DayTable, "newest", lambda self: seen)
        with pytest.raises(Py4JJavaError):
            table.load(kept(spark, ("second", DAY)), RUN)
    assert rows(table.read()) == [("first", DAY)]


def test_other_columns_are_refused(spark, table):
    with pytest.raises(FileNotFoundError):
        table.read()
    table.load(kept(spark, ("old", DAY)), RUN)
    with pytest.raises(TypeError):
        table.load(spark.createDataFrame([(1,)], "k int"), RUN)
