"""Every registered query against DuckDB's answer on the same tables."""

from __future__ import annotations

import re

import __spark_entry__ as registered
import pytest

import oracle

FOLDER = "/root/testdata/sf0.01"
QUERIES = registered.queries()
ANSWERS = registered.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_query_matches_duckdb(spark, duck, name):
    oracle.compare(QUERIES[name](spark, FOLDER), duck, ANSWERS[name])


def test_every_answer_has_a_query_and_only_the_sketch_has_no_answer():
    own = {name for name in QUERIES if not re.match(r"op\d+_|pipeline$", name)}
    assert own - set(ANSWERS) == {"pids_per_cluster_approx"}
    assert set(ANSWERS) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert registered.entry(spark).columns == ["domain", "name", "matched_us", "pairs_us"]
    assert registered.entry(spark).count() > 0
