"""Approximate nearest neighbours by shifted space-filling curves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates (points, dimensions) below 2 ** bits; at most 63 bits in all.

    From the highest bit down, each level's inversions and exchanges of axes are undone for the bits below it, for all points at once; the
    Gray code that remains is decoded and its bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        high, low = np.int64(1) << level, (np.int64(1) << level) - 1
        for axis in range(n):
            flip = (x[axis] & high) != 0
            swap = np.where(flip, 0, (x[0] ^ x[axis]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if axis:
                x[axis] ^= swap
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix = np.where(x[-1] & (np.int64(1) << level), fix ^ ((np.int64(1) << level) - 1), fix)
    x ^= fix
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part: id and all components there and finite, not all zero."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def nearest(
    table: DataFrame,
    every: int = 100,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    curves: int = 12,
    dimensions: int = 6,
    bits: int = 8,
    share: float = 0.125,
    most_rows: int = 16_384,
    fit_rows: int = 20_000,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest rows by Euclidean distance of each row whose id is divisible by `every`.

    Each of `curves` projections turns the vectors at random, keeps `dimensions` coordinates, scales them by the spread of `fit_rows` sampled
    rows (the smallest hashes of their ids; all that reaches the driver), shifts them at random and orders all rows on a Hilbert curve.
    A range partitioning gives every row its rank on every curve; ranks are cut into buckets of equal size, at most `most_rows`. A query's window on
    every curve is `share` of all rows around its rank, the same at any size, but at least 4 (k + 1) rows; it meets them in the buckets that the window
    touches. The bucket results are merged and ranked by the exact distance of the original vectors in double precision, ties by the smaller id.

    Windows are a share of the rows because vectors without structure (as in high-dimensional noise, where the nearest are hardly nearer than
    others) need it for a recall of 0.9 at any size; clustered vectors do with much less. Equal vectors are one entry that stands for its
    k + 1 smallest ids, which is all that can rank, so copies cost one place and lose nothing.

    Null, zero and non-finite vectors and null ids take no part; shorter vectors count as filled up with zeros at their end. A repeated id
    counts once, at its least distance. Fewer than `k` other rows give fewer results, an empty table none.
    """
    rows = _vectors(table, id_col, vector_col)
    size = rows.agg(F.max(F.size("v"))).first()[0] or 1
    rows = rows.select("id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v"))).alias("v"))
    place = Window.partitionBy("v").orderBy("id")
    first = rows.distinct().withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k + 1)
    entries = first.groupBy("v").agg(F.min("id").alias("entry"), F.array_sort(F.collect_list("id")).alias("ids"))
    entries = entries.groupBy("entry", "v").agg(F.first("ids").alias("ids")).withColumn("entry", F.xxhash64("v", "entry"))
    entries = stored(entries, "entries")
    queries = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query"), "v").distinct()
    queries = stored(queries.join(entries.select("entry", "v"), "v").select("query", "entry", "v"), "queries")
    count = entries.count()

    sample = np.array([r[0] for r in entries.orderBy(F.xxhash64("entry"), "entry").limit(fit_rows).select("v").collect()], np.float64).reshape(-1, size)
    random = np.random.default_rng(seed)
    dims = min(dimensions, size)
    turns = [np.linalg.qr(random.normal(size=(size, size)))[0][:, :dims] for _ in range(curves)]
    lows, widths, shifts = [], [], [random.uniform(0, 0.2, dims) for _ in range(curves)]
    for turn in turns:
        y = sample @ turn if len(sample) else np.zeros((1, dims))
        low, high = np.quantile(y, 0.001, 0), np.quantile(y, 0.999, 0)
        lows.append(low)
        widths.append(np.where(high > low, high - low, 1.0))

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(frame["v"]).astype(np.float64)
                for c in range(curves):
                    y = ((x @ turns[c] - lows[c]) / widths[c] * 0.8 + shifts[c]) * (1 << bits)
                    key = hilbert_keys(np.clip(y, 0, (1 << bits) - 1), bits)
                    yield pd.DataFrame({"curve": np.full(len(x), c, np.int32), "key": key, "entry": frame["entry"]})

    parts = max(2, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = entries.select("entry", "v").mapInPandas(keys, "curve int, key long, entry long")
    ordered = ordered.repartitionByRange(parts, "curve", "key", "entry").withColumn("part", F.spark_partition_id())
    ordered = stored(ordered, "ordered")
    inside = Window.partitionBy("part", "curve").orderBy("key", "entry")
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("curve", "part").agg(F.count("*").alias("n"))
    offsets = offsets.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = ordered.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["curve", "part"])
    window = min(count, max(int(np.ceil(share * count)), 4 * (k + 1)))
    buckets = max(1, min(count // max(1, window // 4), max(round(4 / share), -(-count // most_rows))))
    rank = (F.col("r") + F.col("offset")).cast("long")
    ranked = stored(ranked.select("curve", "entry", rank.alias("rank")), "ranked")

    def bucket_of(place: Column) -> Column:
        return F.floor(place * buckets / max(1, count)).cast("int")

    indexed = ranked.join(entries.select("entry", "v"), "entry").select(
        "curve", bucket_of(F.col("rank")).alias("bucket"), "entry", "v", "rank", F.lit(None).cast("long").alias("query")
    )
    # the first rank of a query's window, which stays inside the curve
    low = F.greatest(F.lit(0), F.least(F.col("rank") - window // 2, F.lit(count - window))).cast("long")
    visits = queries.join(ranked, "entry").withColumn("rank", low)
    visits = visits.withColumn("bucket", F.explode(F.sequence(bucket_of(F.col("rank")), bucket_of(F.col("rank") + (window - 1)))))
    visits = visits.select("curve", "bucket", "entry", "v", "rank", "query")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["query"].notna().to_numpy()
        own = frame[~asks]
        out = []
        if len(own) and asks.any():
            own = own.sort_values("rank")
            every, entries_of, ranks = np.stack(own["v"]).astype(np.float64), own["entry"].to_numpy(), own["rank"].to_numpy()
            for query, v, first in zip(frame["query"][asks].astype("int64"), frame["v"][asks], frame["rank"][asks]):
                a, b = np.searchsorted(ranks, (first, first + window))
                x, entry = every[a:b], entries_of[a:b]
                if a == b:
                    continue
                with np.errstate(over="ignore"):
                    d = np.square(x - np.asarray(v, np.float64)).sum(1)
                if np.isinf(d).any():  # components beyond 1e154: the squares are taken of scaled differences
                    d = np.array([math.hypot(*row) for row in (x - np.asarray(v, np.float64)).tolist()])
                    near = np.argsort(d, kind="stable")[: k + 1 + int((d == np.partition(d, min(len(d), k + 1) - 1)[min(len(d), k + 1) - 1]).sum())]
                    out.append(pd.DataFrame({"query": query, "entry": entry[near], "score": d[near]}))
                    continue
                most = min(len(d), k + 1)
                limit = np.partition(d, most - 1)[most - 1]
                near = np.flatnonzero(d <= limit)  # ties at the edge may all rank by their ids
                out.append(pd.DataFrame({"query": query, "entry": entry[near], "score": np.sqrt(d[near])}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "entry": [], "score": []}).astype({"query": "int64", "entry": "int64"})

    met = indexed.unionByName(visits).groupBy("curve", "bucket").applyInPandas(search, "query long, entry long, score double")
    met = met.groupBy("query", "entry").agg(F.min("score").alias("score"))
    found = met.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    found = found.filter("query <> vec_id").groupBy("query", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
