from __future__ import annotations

import pytest

from hemtally.operators import classify_hashes, convert_hashes
from helpers import rows

MD5, SHA1, SHA2 = "a" * 32, "b" * 40, "c" * 64


def test_kinds_by_length_of_lowercase_hex(spark):
    values = [MD5, MD5, SHA1, SHA2, MD5.upper(), "g" * 32, MD5 + "a", " " + MD5, "", None, None]
    df = spark.createDataFrame([(v,) for v in values], "hem string")
    assert rows(classify_hashes(df)) == [("invalid", 5, 5), ("md5", 2, 1), ("sh1", 1, 1), ("sh2", 1, 1)]


def test_only_nulls_are_an_invalid_row_of_zeros(spark):
    df = spark.createDataFrame([(None,), (None,)], "hem string")
    assert rows(classify_hashes(df)) == [("invalid", 0, 0)]


@pytest.fixture
def lookup(spark):
    return spark.createDataFrame(
        [
            ("m1", "s1", "t1", "20240101"),
            ("m2", "s2", "t2", "20240101"),
            ("m1", "s1", "t1", "20240201"),
            ("m1b", "s1", "t9", "20240201"),
            ("m3", None, "t3", "20240201"),
        ],
        "md5 string, sh1 string, sh2 string, date_p string",
    )


def test_converts_through_the_newest_snapshot(spark, lookup):
    client = spark.createDataFrame([("s1",), ("s1",), ("s2",), (None,)], "sh1 string")
    assert rows(convert_hashes(client, lookup, "sha1")) == [("m1",), ("m1b",)]


def test_converts_through_a_given_snapshot(spark, lookup):
    client = spark.createDataFrame([("t2",), ("t3",)], "sh2 string")
    assert rows(convert_hashes(client, lookup, "sha2", snapshot="20240101")) == [("m2",)]


@pytest.mark.parametrize("kind", ["md5", "sh1", ""])
def test_other_kinds_are_refused(spark, lookup, kind):
    with pytest.raises(ValueError):
        convert_hashes(spark.createDataFrame([("s1",)], "sh1 string"), lookup, kind)
