"""Vector codes against plain rounds over all sub-vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemtally.llm import vector_codes
from hemtally.llm.vector_codes import Codebooks, encode_vectors

from .test_edges import clashing

SCHEMA = "vec_id long, embedding array<double>, label int"


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, parts=8, entries=16, rounds=6):
    rows = [r for r in rows if finite(r[1])]
    if not rows:
        return []
    size = max(parts, -(-max(len(v) for _, v, _ in rows) // parts) * parts)
    full = [[*v, *[0.0] * (size - len(v))] for _, v, _ in rows]
    width = size // parts
    subs = [[tuple(math.floor(4096 * x) if abs(x) < 1e9 else int(4096 * x) for x in v[p * width : (p + 1) * width]) for p in range(parts)] for v in full]
    seed = {}
    for (i, *_), v, s in zip(rows, full, subs):
        seed[i] = min(seed.get(i, (v, s)), (v, s))
    known = sorted(i for i in seed if i is not None)[:entries] or [None]
    books = [[seed[i][1][p] for i in known] for p in range(parts)]

    def assigned(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for s in subs:
                members.setdefault(assigned(p, s[p])[1], []).append(s[p])
            for e, xs in members.items():
                books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs))
    most = (1 << 63) - 1
    coded = [[assigned(p, s[p]) for p in range(parts)] for s in subs]
    errors = [min(most, sum(min(most, d) for d, _ in c)) for c in coded]
    by_label = {}
    for (*_, label), e in zip(rows, errors):
        by_label[label] = min(most, by_label.get(label, 0) + e)
    text = ",".join(str(x) for b in books for c in b for x in c)
    return sorted(((i, label, "".join(f"{e:02x}" for _, e in c), e, by_label[label], text) for (i, _, label), c, e in zip(rows, coded, errors)), key=str)


def got(df, **options):
    return sorted(map(tuple, encode_vectors(df, **options).collect()), key=str)


@pytest.mark.parametrize(("seed", "size", "block"), [(0, 16, 256), (1, 24, 4), (2, 8, 1), (3, 64, 16)])
def test_same_as_brute_force(spark, seed, size, block):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(9, size))
    rows = [(int(i), [float(np.float32(x)) for x in centers[r.integers(9)] + r.normal(size=size) * r.choice([0, 0.001, 0.2])], int(r.integers(3))) for i in r.permutation(300)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0] * 8, 1), (5, [0.5] * 8, 1), (5, [1.0] * 8, 1), (2, None, 1), (3, [], None), (4, [nan] * 8, 1), (6, [1.0, inf], 1), (7, [None, 1.0], 1),
        (None, [-0.25, 3.0], None), (8, [-1e-9] * 11, 2), (9, [0.0] * 8, None), (10, [-3.75, 2.5, 1e6], 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(clashing(df).withColumn("uid", F.lit(1)).withColumn("code", F.lit(1))) == brute(rows)
    assert got(df.limit(0)) == [] and got(df.filter("vec_id in (2, 4)")) == []
    assert got(df.filter("vec_id is null")) == brute([rows[8]])
    assert got(df, entries=2, rounds=0) == brute(rows, entries=2, rounds=0)


def test_huge_components_are_exact(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([1e3, -1e38, 3e38, 1e12]) * r.random() for _ in range(16)], i % 2) for i in range(60)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    with pytest.raises(ValueError, match="beyond"):
        encode_vectors(spark.createDataFrame([(1, [1e60], 0)], SCHEMA))


def test_shortlists_lose_no_nearest_entry():
    r = np.random.default_rng(6)
    for _ in range(200):
        entries = r.integers(-50, 50, (1, 16, 3))
        books = Codebooks(entries, False)
        x = r.integers(-50, 50, (1, 3)) + r.integers(-6, 6, (20, 3))
        some, d = books.nearest(0, x, books.shortlist(0, x.min(0), x.max(0)))
        every, e = books.nearest(0, x, np.arange(16))
        assert (some == every).all() and (d == e).all()


def test_blocks_along_the_curve_are_settled_by_their_boxes(spark):
    """Clustered vectors: most blocks keep one entry and are never opened."""
    r = np.random.default_rng(8)
    centers = np.repeat(r.normal(size=(16, 1)) * 20, 16, 1)
    rows = [(i, [float(x) for x in centers[i % 16] + r.normal(size=16) * 0.01], 0) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).select(F.col("vec_id").alias("uid"), F.col("embedding").alias("v"))
    v = np.array([x for _, x, _ in rows])
    blocks = vector_codes._blocks(df, 8, 16, v.min(0), v.max(0), 4096, False, 32).collect()
    books = Codebooks(np.floor(centers * 4096).astype(np.int64).reshape(16, 8, 2).swapaxes(0, 1), False)
    left = [len(books.shortlist(b["part"], *(vector_codes.whole(np.frombuffer(b[k], "<f8"), 4096, False) for k in ("low", "high")))) for b in blocks]
    assert sum(b["n"] for b in blocks) == 8 * 4000 and np.mean(np.array(left) == 1) > 0.7
