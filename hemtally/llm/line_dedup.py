"""Line deduplication by overlapping windows of three consecutive lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, stored, text_hash
from .words import mix

WINDOW = 3
LONG_LINE_WORDS = 50


def line_windows(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, long_line_words: int = LONG_LINE_WORDS
) -> DataFrame:
    """(id, th, h, g, pos, size): a window of lines in the document (id, th), by its hash of 128 bits; `pos` counts lines, `size` is how many it spans.

    Lines are what stands between newlines, without white space at their ends; windows skip blank lines. A line of `long_line_words`
    words or more is a window of its own too, so that a long passage counts between any neighbours.
    """

    def windows(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in chunks(frames, "text"):
            at, h, g, pos, size = [], [], [], [], []
            for i, text in enumerate(rows["text"].tolist()):
                lines = [x.strip() for x in text.split("\n")] if text else []
                where = np.array([p for p, x in enumerate(lines) if x], np.int32)
                raw = b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "replace")) for x in lines if x)
                one, two = np.frombuffer(raw, "<u8").reshape(-1, 2).T
                n = len(one) - window + 1
                if n > 0:
                    rolled, other = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                    for j in range(window):
                        rolled = mix(rolled * np.uint64(0x2545F4914F6CDD1D) + one[j : j + n])
                        other = mix(other * np.uint64(0x9FB21C651E98DF25) + two[j : j + n])
                    at.append(np.full(n, i))
                    h.append(rolled)
                    g.append(other)
                    pos.append(where[:n])
                    size.append(where[window - 1 :] - where[:n] + 1)
                long = [k for k, p in enumerate(where) if len(lines[p]) >= 2 * long_line_words - 1 and len(lines[p].split()) >= long_line_words]
                if long:
                    at.append(np.full(len(long), i))
                    h.append(mix(one[long] + np.uint64(1)))
                    g.append(mix(two[long] + np.uint64(1)))
                    pos.append(where[long])
                    size.append(np.ones(len(long), np.int32))
            if at:
                yield pd.DataFrame({
                    "id": rows["id"].take(np.concatenate(at)).to_numpy(), "th": rows["th"].to_numpy()[np.concatenate(at)],
                    "h": np.concatenate(h).view(np.int64), "g": np.concatenate(g).view(np.int64), "pos": np.concatenate(pos), "size": np.concatenate(size),
                })

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInPandas(windows, f"id {kind}, th long, h long, g long, pos int, size int")


def dedup_lines(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, long_line_words: int = LONG_LINE_WORDS
) -> DataFrame:
    """All columns of `documents`, the text without later occurrences of repeated windows, and n_lines, n_removed.

    Of each window that occurs more than once anywhere, the occurrence with the smallest (id, hash of the text, line) stays; the lines
    that any other occurrence covers, in whatever window, go. So at least one copy of every line stays. Rows with equal id and
    text count as one document and keep equal results; a null id comes first. Null and blank texts stay as they are (n_lines 0 for
    null). Documents with less than `window` lines and no long line stay whole. Input columns named n_lines or n_removed give way to the results.

    A window's first place is a minimum, combined before the shuffle. The table of repeated windows is written, so the join
    of all windows with it has an exchange on either side and adaptive execution can split a window that a third of all documents hold.
    The texts are shuffled once, by document.
    """
    if clash := {"n_lines", "n_removed"} & set(documents.columns):
        documents = documents.drop(*clash)
    windows = line_windows(documents, id_col, text_col, window, long_line_words)
    place = F.struct("id", "th", "pos")
    first = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    first = stored(first.filter("n > 1").select("h", "g", "first"), "repeated-windows")
    later = windows.join(first, ["h", "g"]).filter(place > F.col("first"))
    covered = later.groupBy("id", "th").agg(F.collect_set(F.struct("pos", "size")).alias("covered"))
    named = documents.select(F.struct("*").alias("row")).select(
        "row", F.col(f"row.`{id_col}`").alias("_id"), text_hash(F.col(f"row.`{text_col}`")).alias("_th"), F.col(f"row.`{text_col}`").alias("_text")
    )
    joined = named.join(covered, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")), "left")
    lines = F.split("_text", "\n")
    gone = F.flatten(F.transform("covered", lambda c: F.sequence(c["pos"], c["pos"] + c["size"] - 1)))
    gone = F.array_distinct(gone)
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    kept = F.array_join(F.transform(stays, lambda i: F.get(F.col("_lines"), i)), "\n")
    blank = F.coalesce(F.size(lines), F.lit(0))
    done = joined.withColumn("_gone", gone).withColumn("_lines", lines).select(
        "row", F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept).alias("_kept"),
        F.when(F.col("_text").isNull(), 0).otherwise(blank).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_gone_n"),
    )
    columns = [F.col("_kept").alias(text_col) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in documents.columns]
    return done.select(*columns, "n_lines", F.greatest("_gone_n", F.lit(0)).alias("n_removed"))
