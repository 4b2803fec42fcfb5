"""Benchmark decontamination by the q-gram lemma, diagonal bands and banded alignment."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, stored, text_hash

Q = 8
EDITS = 0.1
#: Characters of benchmark text (compact) that one pass over the documents holds in each task; more items take more passes.
BLOCK_CHARS = 8_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that the compact form leaves out: white space, controls, ASCII punctuation.
_DROPPED = bytes(c for c in range(128) if not chr(c).isalnum())


def compact(text: str | None) -> bytes:
    """Letters and digits of a text, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER, _DROPPED)


class _Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], edits: float):
        self.items = items
        lengths = np.array([len(b) for _, b in items], np.int64)
        self.lengths = lengths
        #: Edits allowed: a share of the length. Where they may leave no q-gram, the item is cut into one piece more than edits, of which one stays whole.
        self.budget = (lengths * edits).astype(np.int64)
        self.least = lengths - Q + 1 - self.budget * Q
        self.short = [(i, _pieces(items[i][1], int(self.budget[i]))) for i in np.flatnonzero(self.least < 1)]
        grams = [_grams(np.frombuffer(b if n >= 1 else b"", np.uint8)) for (_, b), n in zip(items, self.least)]
        all_grams = np.concatenate(grams)
        owner = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        offset = np.concatenate([np.arange(len(g)) for g in grams])
        by = np.argsort(all_grams, kind="stable")
        self.owner, self.offset = owner[by], offset[by]
        self.keys, self.begin = np.unique(all_grams[by], return_index=True)
        self.count = np.diff(np.append(self.begin, len(by)))
        if not len(all_grams):
            self.keys, self.begin, self.count = np.array([(1 << 64) - 1], np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.bits = max(16, int(len(self.keys) * 16).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.keys)] = True

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, offset in the item) of every shared q-gram."""
        grams = _grams(data)
        at = np.flatnonzero(self.seen[self._slot(grams)])
        found = np.searchsorted(self.keys, grams[at])
        found[found == len(self.keys)] = 0
        same = self.keys[found] == grams[at]
        at, found = at[same], found[same]
        n = self.count[found]
        stop = np.cumsum(n)
        k = np.repeat(self.begin[found] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)
        return np.repeat(at, n), self.owner[k], self.offset[k]


def _pieces(item: bytes, edits: int) -> list[tuple[int, bytes]]:
    """(offset, piece) of edits + 1 nearly equal pieces."""
    cuts = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def _grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    return np.ascontiguousarray(np.ndarray((n,), "<u8", np.ascontiguousarray(data).data, strides=(1,)))


def banded_distance(item: np.ndarray, region: np.ndarray, low: int, high: int, budget: int) -> int:
    """Least edits between the whole item and a part of `region`, on diagonals up to `budget` around low to high; budget + 1 if more.

    Row i of the alignment holds the cells of these diagonals (place in the region less i); the part may start on any of them.
    """
    first = low - budget
    width = high - low + 2 * budget + 1
    diagonals = np.arange(first, first + width)
    far = budget + 1
    row = np.where((diagonals >= 0) & (diagonals <= len(region)), 0, far)
    padded = np.full(len(item) + width + abs(first) + len(region) + 2, 256, np.int16)
    shift = max(0, -first)
    padded[shift : shift + len(region)] = region
    steps = np.arange(width)
    for i, c in enumerate(item):
        here = padded[i + first + shift : i + first + shift + width]
        place = diagonals + i  # in the region, of the character consumed by a diagonal step
        over = np.where((place >= 0) & (place < len(region)), row + (here != c), far)
        down = np.append(row[1:], far) + 1  # the item's character has no partner
        row = np.minimum(over, down)
        row = np.minimum(np.minimum.accumulate(row - steps) + steps, far)  # the region's character has none
        if row.min() > budget:
            return far
    return int(row[diagonals + len(item) <= len(region)].min(initial=far))


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    edits: float = EDITS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """All columns of `documents` and `items`: the sorted item ids whose whole text a document holds, but for a share of edits.

    Texts are compared by their letters and digits, A-Z lower-cased. An item matches if some part of the document is within `edits` times
    the item's length of insertions, deletions and replacements (bytes). That many edits destroy at most Q q-grams each, so the part
    shares the rest with the item, on diagonals (place in the document less place in the item) at most that many apart: the q-grams shared
    are counted in overlapping bands of diagonals, bands that reach the lemma's count are aligned. Items so short that the
    lemma says nothing are cut into one piece more than edits; where a piece occurs, it is aligned. Items without a letter or digit match nothing. Null
    and empty texts have no items; equal rows have equal results; an empty benchmark marks nothing; repeated items appear once. An input column named
    items gives way to the result.

    The benchmark is a query set, taken in blocks of about `block_chars` (a longer item alone), of which the driver holds one at a time: a block is
    broadcast and matched with all documents in one pass. If there is one block only, documents are not shuffled; with more, each pass writes which documents
    it found something in, and these meet the documents.
    """
    spark = documents.sparkSession
    if "items" in documents.columns:
        documents = documents.drop("items")
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("item is not null and text is not null")
    kind = benchmark.schema[item_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    nothing = F.expr(f"cast(array() as array<{kind}>)")
    blocks = _blocks(rows.distinct().sort("item", "text").toLocalIterator(), block_chars)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return documents.withColumn("items", nothing)
    if second is None:
        return documents.withColumn("items", F.array_sort(F.array_distinct(_marker(spark.sparkContext.broadcast(first), kind, edits)(text))))
    passes = []
    for block in itertools.chain([first, second], blocks):
        shared = spark.sparkContext.broadcast(block)
        hits = documents.select(text_hash(text).alias("th"), F.md5(text).alias("digest"), _marker(shared, kind, edits)(text).alias("found"))
        passes.append(stored(hits.filter(F.size("found") > 0).distinct(), "hits"))
        shared.destroy()
    every = functools.reduce(DataFrame.unionByName, passes).select("th", "digest", F.explode("found").alias("item"))
    every = every.groupBy("th", "digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    row = documents.select(F.struct("*").alias("row"), text_hash(text).alias("th"), F.md5(text).alias("digest"))
    done = row.join(stored(every, "items"), ["th", "digest"], "left")
    return done.select("row.*", F.coalesce("items", nothing).alias("items"))


def _blocks(rows: Iterable, block_chars: int) -> Iterator[list[tuple[int, bytes]]]:
    block, size = [], 0
    for item, text in rows:
        small = compact(text)
        if not small:
            continue
        if block and size + len(small) > block_chars:
            yield block
            block, size = [], 0
        block.append((item, small))
        size += len(small)
    if block:
        yield block


def _marker(block, kind: str, edits: float):
    @F.pandas_udf(f"array<{kind}>")
    def mark(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _Index(block.value, edits)
        for series in texts:
            rows = series.to_frame("text")
            found = [sorted(x) for part in chunks([rows], "text") for x in _matches(index, [compact(t) for t in part["text"].tolist()])]
            yield pd.Series(found, dtype=object)

    return mark


def _match_short(index: _Index, x: int, pieces: list[tuple[int, bytes]], raw: bytes, begins: np.ndarray, found: list[set[int]]) -> None:
    """Marks the texts that hold a short item: by what stands around each place of each of its pieces."""
    name, item = index.items[x]
    budget, pattern = int(index.budget[x]), np.frombuffer(item, np.uint8)
    for offset, piece in pieces:
        at = raw.find(piece)
        while at >= 0:
            d = int(np.searchsorted(begins, at, "right")) - 1
            if name not in found[d]:
                a, b = max(int(begins[d]), at - offset - budget), min(int(begins[d + 1]) - 1, at - offset + len(item) + budget)
                region = np.frombuffer(raw, np.uint8, b - a, a)
                low = at - offset - a
                if not budget or banded_distance(pattern, region, low, low, budget) <= budget:
                    found[d].add(name)
            # a text that is marked needs no second look
            at = raw.find(piece, at + 1 if name not in found[d] else int(begins[d + 1]))


def _matches(index: _Index, texts: list[bytes]) -> list[set[int]]:
    raw = b" ".join(texts) + b" "  # no q-gram of an item holds the space
    data = np.frombuffer(raw, np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    found: list[set[int]] = [set() for _ in texts]
    for x, pieces in index.short:
        _match_short(index, x, pieces, raw, begins, found)
    at, item, offset = index.hits(data)
    if not len(at):
        return found
    # Bands of twice the budget that begin at every multiple of it (or of 8): any two diagonals a budget apart share a band.
    step = np.maximum(8, index.budget + 1)
    diagonal = at - offset + int(index.lengths.max())
    band = diagonal // step[item]
    order = np.lexsort((band, item))
    item, band, diagonal = item[order], band[order], diagonal[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(item) != 0) | (np.diff(band) != 0)]))
    count = np.diff(np.append(new, len(item)))
    owner, number = item[new], band[new]
    follows = np.zeros(len(new), bool)
    follows[:-1] = (owner[1:] == owner[:-1]) & (number[1:] == number[:-1] + 1)
    both = count + np.where(follows, np.append(count[1:], 0), 0)
    for j in np.flatnonzero(both >= index.least[owner]):
        x = owner[j]
        low = int(number[j] * step[x]) - int(index.lengths.max())
        high = low + 2 * int(step[x]) - 1
        budget, length = int(index.budget[x]), int(index.lengths[x])
        # The band may touch several texts; each is tried by itself.
        d0 = max(0, int(np.searchsorted(begins, low - budget, "right")) - 1)
        d1 = int(np.searchsorted(begins, high + length + budget, "left"))
        for d in range(d0, min(d1, len(texts))):
            if index.items[x][0] in found[d]:
                continue
            a, b = max(int(begins[d]), low - budget), min(int(begins[d + 1]) - 1, high + length + budget)
            if b - a < length - budget:
                continue
            pattern = np.frombuffer(index.items[x][1], np.uint8)
            if index.items[x][1] in data[a:b].tobytes() or banded_distance(pattern, data[a:b], low - a, high - a, budget) <= budget:
                found[d].add(index.items[x][0])
    return found
