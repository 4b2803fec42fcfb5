from __future__ import annotations

import gzip
from datetime import date, timedelta
from pathlib import Path

import pytest

from hemtally.operators import advertiser_cookies, cookies_to_hashes
from hemtally.plans import deliver_cookie_hashes
from helpers import rows

LOG = [
    (date(2024, 1, 30), "101", "d1", "l1"),
    (date(2024, 1, 24), "101", "null", "l2"),
    (date(2024, 1, 23), "101", "d3", None),
    (date(2024, 1, 31), "101", "d4", None),
    (date(2024, 1, 29), "102", "d5", "l5"),
    (date(2024, 1, 28), "101", None, "l1"),
]
GRAPH = [
    ("h1", "d1", "20240130"),
    ("h1", "l1", "20240130"),
    ("h2", "l2", "20240130"),
    ("h3", "d3", "20240130"),
    ("h4", "d4", "20240130"),
    ("h5", "l5", "20240130"),
    ("h6", "null", "20240130"),
    ("h7", "d1", "20240101"),
]


@pytest.fixture
def weblog(spark):
    return spark.createDataFrame(LOG, "log_date date, adv_id string, domain_user_id string, linked_cookie string")


@pytest.fixture
def graph(spark):
    return spark.createDataFrame(GRAPH, "hash string, cookie string, date_p string")


def test_cookies_of_both_kinds_without_the_text_null(weblog):
    assert rows(advertiser_cookies(weblog, "101")) == [("d1",), ("d3",), ("d4",), ("l1",), ("l1",), ("l2",)]


def test_default_window_is_a_week_up_to_the_newest_graph(weblog, graph):
    assert rows(cookies_to_hashes(weblog, graph, "101")) == [("h1",), ("h2",)]


def test_given_end_moves_the_window_but_not_the_graph(weblog, graph):
    assert rows(cookies_to_hashes(weblog, graph, "101", end="20240129")) == [("h1",), ("h2",), ("h3",)]
    assert rows(cookies_to_hashes(weblog, graph, "101", start="20240124", end="20240124")) == [("h2",)]
    assert rows(cookies_to_hashes(weblog, graph, "101", start="20240129")) == [("h1",)]


def test_from_raw_files_to_the_delivered_file(spark, graph, tmp_path):
    for n in range(-8, 2):
        day = date(2024, 1, 30) + timedelta(days=n)
        hour = tmp_path / "log" / f"{day:%Y/%m/%d}" / "07"
        hour.mkdir(parents=True)
        lines = []
        for log_date, adv_id, first_party, third_party in LOG:
            if log_date == day:
                fields = [f"f{i}" for i in range(26)]
                fields[6], fields[8], fields[23] = first_party or "", third_party or "", adv_id
                lines.append("\t".join(fields))
        (hour / "part-0.tsv").write_text("\n".join(lines) + "\n")
    path = deliver_cookie_hashes(spark, str(tmp_path / "log"), graph, "101", str(tmp_path / "out"))
    assert path.endswith("/out/20240130")
    files = list(Path(path).glob("part-*.gz"))
    text = "".join(gzip.open(file, "rt").read() for file in files)
    assert sorted(text.split()) == ["h1", "h2"]
    # Again: the path is replaced.
    assert deliver_cookie_hashes(spark, str(tmp_path / "log"), graph, "101", str(tmp_path / "out")) == path
