"""Best-fit packing by a plan over the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import encoder
from .shared import chunks, stored

PIECES = "piece int, start long, length long, ids_crc32 long"


def token_pieces(
    documents: DataFrame, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """The pieces of each document's ids, `end_id` behind them: (doc_id, piece, start, length, ids_crc32).

    A document longer than `capacity` is cut so that all pieces but the first have exactly that length. A null text counts as empty;
    an empty document is its end id alone. The checksum is that of the ids as little-endian unsigned 32-bit numbers.
    """

    def cut(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(vocabulary, added=True)
        for rows in chunks(frames, "text"):
            owners, pieces, starts, lengths, sums = [], [], [], [], []
            for i, ids in enumerate(code.batch(rows["text"].tolist())):
                data = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                n = len(data) // 4
                edges = [0, *range(n % capacity or capacity, n, capacity), n]
                for p, (a, b) in enumerate(zip(edges, edges[1:])):
                    owners.append(i)
                    pieces.append(p)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(data[4 * a : 4 * b]))
            yield pd.DataFrame({
                "id": rows["id"].take(owners).to_numpy(), "piece": np.array(pieces, np.int32), "start": starts, "length": lengths, "ids_crc32": sums,
            })

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(cut, f"id {kind}, {PIECES}").withColumnRenamed("id", id_col)


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: slots as (length, first rank, ranks, first sequence, sequences, offset).

    Rank r of a length (from 0) that lies in [first rank, first rank + ranks) goes, with i = r - first rank, to sequence
    first sequence + i % sequences at offset + (i // sequences) * length. Sequences filled alike are one class: their ids are
    a range, and a length takes whole classes, tightest room first, and splits at most two. The plan's size thus depends on the number of
    different lengths, not on the number of pieces.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted, of open classes
    classes: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of sequences
    opened = 0

    def put(first: int, n: int, room: int) -> None:
        if room and n:
            if room not in classes:
                classes[room] = []
                insort(rooms, room)
            classes[room].append((first, n))

    def fill(length: int, rank: int, left: int, first: int, n: int, room: int) -> int:
        """Puts up to `left` pieces into sequences that have this room, each filled before the next; returns how many."""
        each = room // length
        full = min(n, left // each)
        if full:
            slots.append((length, rank, full * each, first, full, capacity - room))
            put(first, full, room - each * length)
        rest = left - full * each if full < n else 0
        if rest:
            slots.append((length, rank + full * each, rest, first + full, 1, capacity - room))
            put(first + full, 1, room - rest * length)
            full += 1
        put(first + full, n - full, room)
        return (full - bool(rest)) * each + rest

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left and (i := bisect_left(rooms, length)) < len(rooms):
            room = rooms.pop(i)
            for first, n in classes.pop(room):
                used = fill(length, rank, left, first, n, room) if left else put(first, n, room) or 0
                left, rank = left - used, rank + used
        if left:
            n = -(-left // (capacity // length))
            fill(length, rank, left, opened, n, capacity)
            opened += n
    return slots


def pack(pieces: DataFrame, capacity: int, order: tuple[str, ...] = ("doc_id", "piece"), per_bucket: int = 100_000) -> DataFrame:
    """`pieces` with sequence_id and offset; no sequence exceeds `capacity`, none has gaps.

    The histogram has at most `capacity` rows; only it and the plan pass the driver. A piece's rank within its length is the sum of the
    counts of the hash buckets before its own and its place in its bucket, so a frequent length (such as the full one) is spread over
    many tasks; buckets hold about `per_bucket` pieces at every size. Equal rows are interchangeable. `pieces` is read three times: give a stored
    table.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("every length must be between 1 and the capacity")
    slots = plan_best_fit(histogram, capacity)
    buckets = max(1, sum(histogram.values()) // per_bucket + 1)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_place", F.row_number().over(place) - 1).join(counts, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_place"))
    schema = "length long, _first long, _ranks long, _sequence long, _sequences long, _offset long"
    plan = spark.createDataFrame(pd.DataFrame(slots, columns=[c.split()[0] for c in schema.split(", ")]).astype("int64"), schema)
    i = F.col("_rank") - F.col("_first")
    return (
        ranked.join(plan, "length")
        .filter((i >= 0) & (i < F.col("_ranks")))
        .withColumn("sequence_id", F.col("_sequence") + i % F.col("_sequences"))
        .withColumn("offset", F.col("_offset") + F.floor(i / F.col("_sequences")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(documents: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their places in as few sequences as best-fit decreasing finds.

    An empty table gives an empty result. Columns besides doc_id and text are not read.
    """
    return pack(stored(token_pieces(documents, capacity, vocabulary=vocabulary), "pieces"), capacity)
