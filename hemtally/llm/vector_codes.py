"""Vector codes by parts: sub-vectors in flat blocks along a Hilbert curve; box distances leave each block few entries, whole numbers decide."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curves import hilbert_keys
from .shared import discard, stored

#: Sub-vectors of a block.
BLOCK = 256
_LIMB = 10**30
_LARGEST = (1 << 63) - 1


def whole(x: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x), exactly: `scale` is a power of two; as Python's whole numbers if `wide`."""
    y = np.floor(x * float(scale))
    if wide:
        return np.array([int(v) for v in y.ravel()], object).reshape(y.shape)
    return y.astype(np.int64)


class Codebooks:
    """The entries of every part, (parts, entries, components), and whether numbers need more than 64 bits."""

    def __init__(self, entries: np.ndarray, wide: bool):
        self.entries, self.wide = entries, wide

    def shortlist(self, part: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entries that may be nearest to some point of the box: none farther at its nearest than another one at its farthest."""
        entries = self.entries[part]
        out = np.maximum(np.maximum(low - entries, entries - high), 0)
        far = np.maximum(np.abs(entries - low), np.abs(high - entries))
        return np.flatnonzero((out * out).sum(1) <= (far * far).sum(1).min())

    def nearest(self, part: int, x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each sub-vector; of equally near entries the first."""
        distances = np.empty((len(x), len(among)), x.dtype)
        for j, e in enumerate(among):
            d = x - self.entries[part, e]
            distances[:, j] = (d * d).sum(1)
        best = distances.argmin(1)
        return among[best], distances[np.arange(len(x)), best]


def _parts(v: np.ndarray, parts: int) -> np.ndarray:
    return v.reshape(len(v), parts, -1)


def _blocks(kept: DataFrame, parts: int, size: int, low: np.ndarray, high: np.ndarray, scale: int, wide: bool, block: int) -> DataFrame:
    """(part, n, uids, data, low, high, sums): runs of sub-vectors of one part in Hilbert order, with their box and their sum."""
    width = size // parts
    bits = max(1, min(8, 60 // width))
    axes = min(width, 60 // bits)
    span = np.where(high > low, high / 2 - low / 2, 1.0)

    def order(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 4096):
                rows = frame.iloc[at : at + 4096]
                v = np.stack(rows["v"]).astype("<f8")
                cells = np.clip((v / 2 - low / 2) / span * (1 << bits), 0, (1 << bits) - 1)
                for p, (x, c) in enumerate(zip(_parts(v, parts).swapaxes(0, 1), _parts(cells, parts).swapaxes(0, 1))):
                    data = np.ascontiguousarray(x)
                    yield pd.DataFrame({
                        "part": np.full(len(v), p, np.int32), "key": hilbert_keys(c[:, :axes], bits), "uid": rows["uid"].to_numpy(),
                        "data": [r.tobytes() for r in data],
                    })

    columns = ["part", "n", "uids", "data", "low", "high", "sums"]

    def one(rows: pd.DataFrame) -> tuple:
        x = np.frombuffer(b"".join(rows["data"]), "<f8").reshape(-1, width)
        sums = [str(s) for s in whole(x, scale, wide).sum(0)]
        return int(rows["part"].iloc[0]), len(rows), rows["uid"].to_numpy().tobytes(), x.tobytes(), x.min(0).tobytes(), x.max(0).tobytes(), sums

    def pack(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = pd.DataFrame()
        for frame in frames:
            frame = pd.concat([rest, frame], ignore_index=True) if len(rest) else frame
            edges = np.flatnonzero(np.diff(frame["part"].to_numpy(), prepend=-1)).tolist()
            cuts = [c for a, b in itertools.pairwise([*edges, len(frame)]) for c in range(a, b, block)]
            if len(cuts) > 1:
                yield pd.DataFrame([one(frame.iloc[a:b]) for a, b in itertools.pairwise(cuts)], columns=columns)
            rest = frame.iloc[cuts[-1] :] if cuts else rest
        if len(rest):
            yield pd.DataFrame([one(rest)], columns=columns)

    ordered = kept.select("uid", "v").mapInPandas(order, "part int, key long, uid long, data binary")
    ordered = ordered.repartitionByRange("part", "key", "uid").sortWithinPartitions("part", "key", "uid")
    return stored(ordered.mapInPandas(pack, "part int, n int, uids binary, data binary, low binary, high binary, sums array<string>"), "blocks")


def _round(blocks: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    """The codebooks after one assignment: floors of the means; unused entries stay. Every task returns at most one row per part and entry."""
    parts, _, width = books.entries.shape

    def partial(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = {}, {}

        def put(key: tuple[int, int], total: Iterable, n: int) -> None:
            counts[key] = counts.get(key, 0) + n
            before = sums.get(key)
            sums[key] = [int(t) for t in total] if before is None else [a + int(t) for a, t in zip(before, total)]

        for frame in frames:
            for b in frame.itertuples():
                low, high = (whole(np.frombuffer(e, "<f8"), scale, books.wide) for e in (b.low, b.high))
                among = books.shortlist(b.part, low, high)
                if len(among) == 1:
                    put((b.part, int(among[0])), b.sums, b.n)
                    continue
                x = whole(np.frombuffer(b.data, "<f8").reshape(-1, width), scale, books.wide)
                entry, _ = books.nearest(b.part, x, among)
                for e in np.unique(entry):
                    own = x[entry == e]
                    put((b.part, int(e)), own.sum(0), len(own))
        if sums:
            yield pd.DataFrame(
                [(p, e, n, *(Decimal(limb) for s in sums[p, e] for limb in divmod(s, _LIMB))) for (p, e), n in counts.items()], columns=columns
            )

    columns = ["part", "entry", "n", *(f"{k}{i}" for i in range(width) for k in ("high", "low"))]
    kinds = "part int, entry int, n long, " + ", ".join(f"{c} decimal(38,0)" for c in columns[3:])
    found = blocks.mapInPandas(partial, kinds).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns[3:])).collect()
    entries = books.entries.copy()
    for r in found:  # at most parts x entries rows
        total = [int(r[f"high{i}"]) * _LIMB + int(r[f"low{i}"]) for i in range(width)]
        entries[r["part"], r["entry"]] = [t // r["n"] for t in total]
    return Codebooks(entries, books.wide)


def encode_vectors(
    table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", block: int = BLOCK,
) -> DataFrame:
    """(id, label, code, error, label_error, codebooks) of every kept row: the entries that its parts got in the last assignment, two hex digits
    each, the squared distances in total, those of all rows with the same label, and the entries' components by part, entry and place, joined by commas.

    Rows whose vector is null or holds a null or non-finite component are left out. Components become floor(scale * x) (scale a power of two), exactly at any
    magnitude up to 1e50 (beyond, an error is raised); sums and distances are whole numbers. `error` and `label_error` stop at 2 ** 63 - 1. Shorter vectors count as
    filled up with zeros at their end, as do vectors whose length is no multiple of `parts`. The codebooks start with the vectors of the `entries`
    smallest ids; a repeated id counts once, with its smallest vector, and a null id comes last, if there are no others. Repeated rows are all coded and count
    as often as they occur. Fewer ids give smaller codebooks; without rows the result is empty. Null labels are one label. Other columns don't matter.

    1. Kept rows get a number and are written; a second pass lays the sub-vectors of each part along a Hilbert curve (range partitioning; the number breaks
       ties, so that equal vectors split too) and cuts them into flat blocks of `block`, with their smallest and largest corner and their sum.
    2. In each round the corners' distances leave a block a shortlist of entries. One left: the block's sum counts whole. Several: the sub-vectors are
       compared with those alone. Only sums per part and entry reach the driver.
    3. A last assignment gives the codes, which meet their row by its number.
    """
    if scale & (scale - 1):
        raise ValueError("scale is not a power of two")
    spark = table.sparkSession
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), vector.alias("v"))
    rows = rows.filter(F.coalesce(finite, F.lit(False)))
    length = rows.agg(F.max(F.size("v"))).first()[0]
    if length is None:
        kind = rows.schema["label"].dataType.simpleString()
        return spark.createDataFrame([], f"id long, label {kind}, code string, error long, label_error long, codebooks string")
    size = max(parts, -(-length // parts) * parts)
    full = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v")))
    kept = stored(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "label", full.alias("v")), "vectors")

    def edges(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                v = np.stack(frame["v"])
                yield pd.DataFrame({"place": np.arange(size), "low": v.min(0), "high": v.max(0)})

    found = kept.select("v").mapInPandas(edges, "place int, low double, high double").groupBy("place").agg(F.min("low"), F.max("high")).collect()
    low, high = (np.array([r[k] for r in sorted(found)]) for k in (1, 2))
    largest = float(max(-low.min(), high.max(), 1.0))
    if largest > 1e50:
        raise ValueError(f"a component of magnitude {largest} is beyond 1e50")
    wide = size // parts * (2 * int(largest * scale) + 2) ** 2 >= 1 << 62
    ids = [r[0] for r in kept.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    known = [i for i in ids if i is not None] or ids
    seeds = kept.filter(F.col("id").isin(known) if known != [None] else F.col("id").isNull())
    seeds = seeds.groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()
    seeds = whole(np.array([r["v"] for r in seeds], np.float64), scale, wide)
    books = Codebooks(_parts(seeds, parts).swapaxes(0, 1).copy(), wide)

    blocks = _blocks(kept, parts, size, low, high, scale, wide, block)
    for _ in range(rounds):
        books = _round(blocks, books, scale)

    def assign(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame.itertuples():
                lows, highs = (whole(np.frombuffer(e, "<f8"), scale, wide) for e in (b.low, b.high))
                x = whole(np.frombuffer(b.data, "<f8").reshape(b.n, -1), scale, wide)
                entry, error = books.nearest(b.part, x, books.shortlist(b.part, lows, highs))
                error = np.minimum(error, _LARGEST).astype(np.int64)
                yield pd.DataFrame({"uid": np.frombuffer(b.uids, np.int64), "part": np.int32(b.part), "entry": entry.astype(np.int32), "error": error})

    def bounded(total: Column) -> Column:
        return F.least(total, F.lit(_LARGEST).cast("decimal(38,0)")).cast("long")

    coded = blocks.mapInPandas(assign, "uid long, part int, entry int, error long").groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("part", "entry"))).alias("c"), bounded(F.sum(F.col("error").cast("decimal(38,0)"))).alias("error")
    )
    code = F.array_join(F.transform("c", lambda c: F.lpad(F.lower(F.hex(c["entry"])), 2, "0")), "")
    done = stored(kept.select("uid", "id", "label").join(coded, "uid").select("id", "label", code.alias("code"), "error"), "codes")
    discard(blocks)
    discard(kept)
    by_label = done.groupBy(F.col("label").alias("of")).agg(bounded(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    by_label = stored(by_label, "label-errors")
    text = ",".join(str(x) for x in books.entries.ravel())
    return done.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("id", "label", "code", "error", "label_error", F.lit(text).alias("codebooks"))
