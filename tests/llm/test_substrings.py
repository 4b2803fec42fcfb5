"""Substring deduplication against a plain version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemtally.llm import substrings
from hemtally.llm.substrings import dedup_substrings
from hemtally.llm.words import rolling_hashes

from .test_edges import clashing

SCHEMA = "doc_id long, text string"


def words(text):
    for c in "\t\n\v\f\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, window):
    """Per row (id, number of words, kept words, removed intervals)."""
    least = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[a : a + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for a in range(len(w) - window + 1):
            if i is not None and least[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        edges = [p for p in sorted(gone) if p - 1 not in gone], [p + 1 for p in sorted(gone) if p + 1 not in gone]
        out.append((i, len(w), len(gone), *edges, " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def got(df, window, **options):
    return sorted(((r[0], r[1], r[2], list(r[3]), list(r[4]), r[5]) for r in dedup_substrings(df, window, **options).collect()), key=str)


@pytest.mark.parametrize(("seed", "window", "options"), [(0, 13, {}), (1, 3, {}), (2, 3, {"unit_chars": 300, "bucket_windows": 8}), (3, 1, {"unit_chars": 1})])
def test_same_as_brute_force(spark, seed, window, options):
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(r.randint(1, 40))] for _ in range(8)]
    rows = []
    for _ in range(150):
        w = [x for _ in range(r.randint(0, 4)) for x in [*r.choice(passages), *(r.choice("xyzXYZ") for _ in range(r.randint(0, 9)))]]
        rows.append((r.choice([r.randrange(-50, 50), r.randrange(1 << 40), r.randrange(50)]), r.choice([" ", "\n", "  \t", "\x0b"]).join(w)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df, window, **options) == brute(rows, window)


def test_edges(spark):
    long = " ".join(f"word{i}" for i in range(200_000))
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "a b c"), (5, "a b c"), (6, "a b"), (7, "a b c A b c"), (None, "a b c"), (None, "n u l l"), (8, "n u l l"),
        (9, "r r r r r"), (10, "r r r r r r"), (11, long), (12, "x " + long), (-3, "z a b c"), ((1 << 62) + 1, "q q q q"), ((1 << 62) + 2, "q q q q"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(clashing(df).withColumn("unit", F.lit(1)).withColumn("known", F.lit(2)), 3) == brute(rows, 3)
    assert dedup_substrings(df.limit(0)).collect() == []
    assert dedup_substrings(df.filter("doc_id <= 3 or doc_id is null"), 13).count() == 6


def test_a_passage_of_many_documents_is_sent_once_per_unit(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"{passage} own{i}") for i in range(500)], SCHEMA).coalesce(1)
    sent = substrings._sent(substrings._units(df, "doc_id", "text", 1 << 20), 13, 0)
    assert sent.agg(F.sum("n")).first()[0] == 48 + 500
    assert dedup_substrings(df).agg(F.sum("n_removed")).first()[0] == 499 * 60


def test_rolling_hashes_are_polynomials():
    w = np.array([3, 1, 4, 1, 5, 9, 2, 6], np.uint64)
    h = rolling_hashes(w, 3, 0x9E3779B97F4A7C15)
    assert len(h) == 6 and len(set(h.tolist())) == 6
    assert (rolling_hashes(np.concatenate([w, w]), 3, 0x9E3779B97F4A7C15)[8:14] == h).all()
    assert len(rolling_hashes(w[:2], 3, 5)) == 0


def test_narrow_values_come_back():
    for values in ([0], [1, 255], [256, 0, 7], [(1 << 64) - 1, 0]):
        a = np.array(values, np.uint64)
        assert substrings._wide(b"xy" + substrings._narrow(a), len(a), 2)[0].tolist() == values
