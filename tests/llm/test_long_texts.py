"""One text with very many matches takes time in proportion to its length."""

import time

import pytest
from pyspark.sql import functions as F

from hemtally.llm import line_dedup, pii


@pytest.fixture
def timed():
    begin = time.monotonic()
    return lambda: time.monotonic() - begin


def test_addresses_of_one_text(spark, timed):
    df = spark.createDataFrame([(1, "x@y.z " * 50_000)], "doc_id long, text string")
    assert pii.personal_data(df).select(F.size("base")).first()[0] == 50_000
    assert timed() < 100


def test_lines_of_one_text(spark, timed):
    text = "\n".join(str(i) for i in range(40_000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(df).collect()} == {1: (text, 0), 2: ("", 40_000)}
    assert timed() < 60


def test_digits_of_one_word(spark, timed):
    df = spark.createDataFrame([(1, "9." * 200_000), (2, "1" * 500_000)], "doc_id long, text string")
    assert {r["doc_id"]: len(r["base"]) for r in pii.personal_data(df).collect()} == {1: 50_000, 2: 0}
    assert timed() < 100
