"""Substring deduplication: Rabin-Karp hashes of all windows of words, met in packed buckets; repeated windows merge into removal intervals."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, stored
from .words import mix, rolling_hashes, word_hashes

WINDOW = 13
#: Characters of the texts that make a unit, and windows that a bucket of hashes holds about.
UNIT_CHARS = 4 << 20
BUCKET_WINDOWS = 1 << 19
#: Windows after which a task sends on what it has of a unit; only a unit with a very long text reaches it.
MOST_WINDOWS = 1 << 21
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned values by the bytes that the largest needs: their number, then each byte of all values."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _wide(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    width = data[at]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(width, n).T
    return out.view("<u8").ravel(), at + 1 + n * width


def _units(documents: DataFrame, id_col: str, text_col: str, unit_chars: int) -> DataFrame:
    """(unit, known, id, text) of every row, written: what a task reads one after another, in units of bounded length."""

    def deal(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, size = TaskContext.get().partitionId() << 32, 0
        for frame in frames:
            units = []
            for n in frame["text"].str.len().fillna(0).astype("int64").tolist():
                if size and size + n > unit_chars:
                    unit, size = unit + 1, 0
                size += n + 64
                units.append(unit)
            yield frame.assign(unit=np.array(units, np.int64))[["unit", "known", "id", "text"]]

    number = F.col(id_col).cast("long")
    rows = documents.select(number.isNotNull().alias("known"), F.coalesce(number, F.lit(0)).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInPandas(deal, "unit long, known boolean, id long, text string"), "substring-units")


def _windows(texts: list[str | None], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every window, the text that it is in, and where each text's words begin."""
    words, at = word_hashes(texts, lower=False)
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    n = max(0, len(words) - window + 1)
    inside = np.flatnonzero(text[:n] == text[window - 1 :]) if n else np.empty(0, np.int64)
    first = rolling_hashes(words, window, _BASES[0])[inside]
    second = rolling_hashes(mix(words ^ np.uint64(0xA24BAED4963EE407)), window, _BASES[1])[inside]
    return first, second, inside, at


def _packed(unit: int, first: np.ndarray, second: np.ndarray, ids: np.ndarray, bits: int) -> pd.DataFrame:
    """(bucket, unit, n, data): each distinct window of the unit once, with the smallest and the largest id that holds it."""
    order = np.argsort(first, kind="stable")
    first, second, ids = first[order], second[order], ids[order]
    begins = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
    low, high = np.minimum.reduceat(ids, begins), np.maximum.reduceat(ids, begins)
    first, second = first[begins], second[begins]
    bucket = (second >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(first), np.int64)
    order = np.lexsort((low, bucket))
    first, extra, low, high, bucket = first[order], second[order].astype(np.uint8), low[order], high[order], bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    out = []
    for a, b in itertools.pairwise([*edges.tolist(), len(bucket)]):
        steps = np.diff(low[a:b].view(np.uint64), prepend=low[a : a + 1].view(np.uint64))
        data = first[a:b].tobytes() + extra[a:b].tobytes() + low[a : a + 1].tobytes() + _narrow(steps) + _narrow((high[a:b] - low[a:b]).view(np.uint64))
        out.append((int(bucket[a]), unit, b - a, data))
    return pd.DataFrame(out, columns=["bucket", "unit", "n", "data"])


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, ...]:
    """(hash, extra byte, smallest id, largest id)."""
    first, extra = np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint8, n, 8 * n)
    steps, at = _wide(data, n, 9 * n + 8)
    low = np.frombuffer(data, np.int64, 1, 9 * n) + np.cumsum(steps).view(np.int64)
    span, _ = _wide(data, n, at)
    return first, extra, low, low + span.view(np.int64)


def _sent(units: DataFrame, window: int, bits: int) -> DataFrame:
    def send(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, held, count = None, [], 0
        for rows in chunks(frames, "text"):
            rows = rows[rows["known"]]
            for now, part in rows.groupby("unit", sort=False):
                if held and (now != unit or count >= MOST_WINDOWS):
                    yield _packed(unit, *map(np.concatenate, zip(*held)), bits)
                    held, count = [], 0
                unit = now
                first, second, inside, at = _windows(part["text"].tolist(), window)
                if len(first):
                    held.append((first, second, np.repeat(part["id"].to_numpy(np.int64), np.diff(at))[inside]))
                    count += len(first)
        if held:
            yield _packed(unit, *map(np.concatenate, zip(*held)), bits)

    return units.mapInPandas(send, "bucket long, unit long, n int, data binary")


def _repeated(sent: DataFrame) -> DataFrame:
    """(unit, n, data): the windows of a unit that start in a document with a smaller id than one that holds them there, and that smallest id."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(d, n) for d, n in zip(rows["data"], rows["n"])]
        first, extra, low, high = (np.concatenate(c) for c in zip(*parts))
        at = np.repeat(np.arange(len(rows)), rows["n"])
        order = np.lexsort((extra, first))
        begins = np.flatnonzero(np.append(True, (first[order][1:] != first[order][:-1]) | (extra[order][1:] != extra[order][:-1])))
        least = np.empty(len(first), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(low[order], begins), np.diff(np.append(begins, len(first))))
        hit = np.flatnonzero(high > least)
        hit = hit[np.lexsort((first[hit], at[hit]))]
        edges = np.flatnonzero(np.diff(at[hit], prepend=-1))
        out = []
        for a, b in itertools.pairwise([*edges.tolist(), len(hit)]):
            own = hit[a:b]
            base = least[own].min()
            data = first[own].tobytes() + extra[own].tobytes() + base.tobytes() + _narrow((least[own] - base).view(np.uint64))
            out.append((int(rows["unit"].iloc[at[own[0]]]), b - a, data))
        return pd.DataFrame(out, columns=["unit", "n", "data"])

    return sent.groupBy("bucket").applyInPandas(meet, "unit long, n int, data binary")


def _known_repeats(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, extra byte, smallest id), sorted by hash."""
    first, extra, least = [np.empty(0, np.uint64)], [np.empty(0, np.uint8)], [np.empty(0, np.int64)]
    for data, n in zip(rows["data"], rows["n"]):
        first.append(np.frombuffer(data, np.uint64, n))
        extra.append(np.frombuffer(data, np.uint8, n, 8 * n))
        least.append(np.frombuffer(data, np.int64, 1, 9 * n) + _wide(data, n, 9 * n + 8)[0].view(np.int64))
    first, extra, least = map(np.concatenate, (first, extra, least))
    order = np.lexsort((extra, first))
    return first[order], extra[order], least[order]


def _intervals(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals that windows of one length cover; `starts` is sorted."""
    opens = np.flatnonzero(np.append(True, starts[1:] > starts[:-1] + window)) if len(starts) else np.empty(0, np.int64)
    closes = np.append(opens[1:], len(starts))[: len(opens)] - 1
    return starts[opens], starts[closes] + window


def dedup_substrings(
    documents: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", unit_chars: int = UNIT_CHARS,
    bucket_windows: int = BUCKET_WINDOWS,
) -> DataFrame:
    """(id, n_words, n_removed, starts, ends, text) per row: `text` is the kept words joined by one space; the intervals [start, end) of words went.

    Words stand between ASCII white space and are compared unchanged. A window is `window` consecutive words of one document. A word goes if a
    window that covers it also starts in a document with a smaller id, in the input as it is; so of any passage the copies in the document
    with the smallest id stay, all of them if it repeats there. Overlapping and adjoining windows merge into maximal intervals.

    Null and blank texts and those with less than `window` words have no window and lose nothing (a null text: no words, ""). Rows with
    the same id count as one document. Rows with a null id keep everything and take nothing from others. Ids are whole numbers. Other columns
    don't matter, whatever their names; an empty table gives an empty result.

    1. The rows are written in units of about `unit_chars` characters, so that later steps read the same units again.
    2. A task sends each distinct window of a unit once: two Rabin-Karp hashes, the smallest and the largest id that holds it in the unit, packed by
       bucket (the first bits of the second hash, so many that a bucket holds about `bucket_windows`). A window that a third of all documents
       hold arrives once per unit. Bucket, first hash and 8 bits more make a key of 72 bits and the logarithm of the number of buckets.
    3. A bucket finds each window's smallest id and answers the units that hold it in a larger one.
    4. Units meet their answers, hash their texts again and merge what is covered.

    Steps 2 and 3 are done and written before 4; shuffles of an earlier step are gone by then.
    """
    units = _units(documents, id_col, text_col, unit_chars)
    chars = units.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1.0, chars / 6 / bucket_windows)))))
    repeated = stored(_repeated(_sent(units, window, bits)), "repeated-windows")

    def remove(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        keys, extra, least = _known_repeats(answers)
        out = []
        for part in chunks([rows], "text"):
            texts = part["text"].tolist()
            first, second, inside, at = _windows(texts, window)
            ids, known = part["id"].to_numpy(np.int64), part["known"].to_numpy(bool)
            place = np.repeat(np.arange(len(texts)), np.diff(at))[inside]
            hit = np.zeros(len(first), bool)
            if len(keys):
                # equal first hashes are next to each other, by their extra byte
                found = np.searchsorted(keys, first)
                for _ in range(2):
                    ok = found < len(keys)
                    ok[ok] = keys[found[ok]] == first[ok]
                    same = ok.copy()
                    same[ok] = extra[found[ok]] == second[ok].astype(np.uint8)
                    hit[same] = ids[place[same]] > least[found[same]]
                    found = found + (ok & ~same)
            hit &= known[place]
            starts, of = inside[hit], place[hit]
            bounds = np.searchsorted(of, np.arange(len(texts) + 1))
            froms, tos, kept, n_words, n_removed = [], [], [], [], []
            for i, text in enumerate(texts):
                begin, end = _intervals(starts[bounds[i] : bounds[i + 1]] - at[i], window)
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                n_words.append(len(words))
                n_removed.append(int((end - begin).sum()))
                if len(begin):
                    stays = np.ones(len(words), bool)
                    for a, b in zip(begin, end):
                        stays[a:b] = False
                    words = itertools.compress(words, stays.tolist())
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                froms.append(begin)
                tos.append(end)
            out.append(pd.DataFrame({
                "id": pd.array(np.where(known, ids, 0), "Int64"), "n_words": n_words, "n_removed": n_removed, "starts": froms, "ends": tos,
                "text": kept,
            }))
            out[-1].loc[~known, "id"] = pd.NA
        return pd.concat(out)

    sides = units.groupBy("unit").cogroup(repeated.groupBy("unit"))
    done = sides.applyInPandas(remove, "id long, n_words long, n_removed long, starts array<long>, ends array<long>, text string")
    return done.withColumnRenamed("id", id_col) if id_col != "id" else done
