"""Nearest neighbours: few, long, mixed and extreme vectors; recall through the operator."""

import numpy as np
import pytest

from hemtally.llm import curves

SCHEMA = "vec_id long, embedding array<double>"


def found(df, **options):
    out = {}
    for r in sorted(curves.nearest(df, **options).collect()):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def brute(ids, x, q, k=10):
    d = np.sqrt(np.square(x - x[q]).sum(1))
    return [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if j != q][:k]


@pytest.mark.parametrize("n", [1, 2, 8, 12, 30, 45])
def test_few_vectors_give_all_candidates(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 6))
    got = found(spark.createDataFrame([(i * 50, x[i].tolist()) for i in range(n)], SCHEMA))
    for q in range(0, n, 2):
        assert got.get(q * 50, []) == brute(np.arange(n) * 50, x, q)


def test_doubles_and_lengths_are_kept(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0 + 1e-9, 0.0]), (2, [1.0]), (3, [1e300, 0.0]), (4, [0.0, 0.0]), (5, [float("inf"), 1.0]), (6, None), (7, [1.0, 0.0, 2.0]), (8, [])]
    got = found(spark.createDataFrame(rows, SCHEMA))[0]
    assert [i for i, _ in got] == [2, 1, 7, 3]
    assert [s for _, s in got[:3]] == [0.0, (1.0 + 1e-9) - 1.0, 2.0] and got[3][1] == pytest.approx(1e300)


@pytest.mark.parametrize("n", [500, 2000])
def test_recall_is_the_same_at_every_size(spark, n):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 64)).astype(np.float32).astype(np.float64)
    got = found(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), every=10)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in brute(np.arange(n), x, q)}) / 10 for q in range(0, n, 10)]
    assert len(got) == n // 10 and np.mean(hits) >= 0.9
