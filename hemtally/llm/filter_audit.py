"""Audit of interacting filters: each mask of failures is one wide integer that holds the outcomes of all steps of all orders; integers add up per part."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STATISTICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bytes of a field. A field counts documents of one part, fewer than 2 ** 63, so no sum reaches the next field.
FIELD = 8
#: Characters between words, and characters that no text may hold.
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"
#: Parts whose integers a task holds before it sends them on; one part takes 29 KB.
MOST_PARTS = 256


def failures(text: Column) -> list[Column]:
    """Whether a text fails A (under 200 words), B (under half of its words distinct), C (over 2 % capitals), D (holds a mark)."""
    words = F.filter(F.split(text, BETWEEN_WORDS), lambda w: w != "")
    return [
        F.size(words) < 200,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 2,
        text.rlike(MARKS),
    ]


def outcome(mask: int, good: bool, toxic: bool) -> int:
    """The wide integer of one document: a field of FIELD bytes for each order, step and statistic."""
    fields = []
    for order in ORDERS:
        lost = False
        for name in order:
            fails = bool(mask >> FILTERS.index(name) & 1)
            here = fails and not lost
            fields += [not (lost or fails), here, fails and lost, mask == 1 << FILTERS.index(name), here and good, here and toxic]
            lost = lost or fails
    return int.from_bytes(np.array(fields, f"<u{FIELD}").tobytes(), "little")


def masked(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, n): how many documents of a part fail which filters; bits 5 and 6 of the mask are the labels.

    Texts shrink to a digest and four bits before anything is shuffled. Rows of one text, part and labels are combined, those with the
    smallest id apart; a text that a third of all documents have is a few rows per part by the time that its first id is looked for.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = documents.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        sum((f.cast("int") * (1 << i) for i, f in enumerate(failures(text))), F.lit(0)).alias("mask"),
    )
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).cast("int").alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).cast("int").alias("toxic"),
    )
    bits = F.col("mask") + F.coalesce("good", F.lit(0)) * 32 + F.coalesce("toxic", F.lit(0)) * 64
    slim = slim.join(marks, "id", "left").select("id", "part", "digest", bits.alias("mask"))
    each = slim.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    some = each.groupBy("digest", "part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("nameless"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    least = F.min("first.id").over(Window.partitionBy("digest"))
    some = some.withColumn("stays", F.coalesce("nameless", F.lit(0)) + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    pair = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("stays").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stays")).alias("n"))
    )
    return some.select("part", F.explode(pair).alias("x")).select("part", "x.mask", "x.n").filter("n > 0")


def _add(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Wide integers of (part, mask, n) rows, added up by part; a task sends each part once, or more often if it meets very many parts."""
    wide, held, task = {}, {}, TaskContext.get().partitionId()

    def send() -> pd.DataFrame:
        return pd.DataFrame([(part, task, total.to_bytes(len(ORDERS) * 5 * len(STATISTICS) * FIELD, "little")) for part, total in held.items()],
                            columns=["part", "task", "total"])

    for frame in frames:
        for (part, mask), n in frame.groupby(["part", "mask"])["n"].sum().items():
            if mask not in wide:
                wide[mask] = outcome(mask & 31, bool(mask & 32), bool(mask & 64))
            held[part] = held.get(part, 0) + wide[mask] * int(n)
            if len(held) > MOST_PARTS:
                yield send()
                held.clear()
    if held:
        yield send()


def _total(rows: pd.DataFrame) -> int:
    return sum(int.from_bytes(t, "little") for t in rows["total"])


def audit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order of the five filters and step.

    A filter's letter is `filter_order[step - 1]`; E fails a text that a smaller id has too, in any part, removed or not. Null texts are empty, null parts
    are the empty part. Rows that share an id and a text fail E together or not at all; a row with a null id neither fails E nor makes others fail. A
    document is good (toxic) if any row of `labels` with its id says 1; labels of unknown documents don't count. Without documents there are no
    rows; other columns don't matter.

    A document's outcome depends on its five failures and two labels only. Each such mask stands for one integer of 3,600 fields (600 steps, six statistics);
    tasks add them up per part, partial sums are added in two rounds, by part and some of the tasks, and then by part, and the fields are read out
    of the one total. shapley adds a filter's `removed` over the orders.
    """
    sums = masked(documents, labels, id_col, text_col, part_col).mapInPandas(_add, "part string, task int, total binary")
    width = len(ORDERS) * 5 * len(STATISTICS) * FIELD

    def combine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "total": [_total(rows).to_bytes(width, "little")]})

    def unpack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.frombuffer(_total(rows).to_bytes(width, "little"), f"<u{FIELD}").astype(np.int64).reshape(len(ORDERS), 5, len(STATISTICS))
        removed = counts[:, :, STATISTICS.index("removed")]
        letters = np.array([list(o) for o in ORDERS])
        share = {name: int(removed[letters == name].sum()) for name in FILTERS}
        out = pd.DataFrame(counts.reshape(-1, len(STATISTICS)), columns=list(STATISTICS))
        out.insert(0, "part", key[0])
        out.insert(1, "filter_order", np.repeat(ORDERS, 5))
        out.insert(2, "step", np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS)))
        out["shapley"] = [share[name] for name in letters.ravel()]
        return out

    partly = sums.withColumn("some", F.col("task") % 64).groupBy("part", "some").applyInPandas(combine, "part string, total binary")
    return partly.groupBy("part").applyInPandas(
        unpack, "part string, filter_order string, step int, " + ", ".join(f"{s} long" for s in (*STATISTICS, "shapley"))
    )
