"""Quality of documents by a linear-chain conditional random field over their lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks, discard, stored
from .words import hashes_between, mix

#: Labelled documents that training reads at most, by the smallest hash of their ids, and their lines in all.
TRAIN_DOCUMENTS = 3_000
TRAIN_LINES = 200_000
THRESHOLD = 0.7
#: The share of a good document's length that is good at least, that of a bad one at most; rounds in which lines are labelled anew.
GOOD_SHARE, BAD_SHARE, LATENT_ROUNDS = 0.9, 0.2, 2

#: Kinds of bytes whose shares are features: upper, lower (and all beyond ASCII), digit, other printing, white space, "!".
_KINDS = np.zeros((6, 256), np.int64)
for _c in range(256):
    _ch = chr(_c)
    _KINDS[0 if 65 <= _c <= 90 else 1 if 97 <= _c <= 122 or _c >= 128 else 2 if 48 <= _c <= 57 else 4 if _ch.isspace() else 3, _c] = 1
_KINDS[5, 33] = 1
_SYMBOL = _KINDS[3].astype(bool)


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of features per non-blank line, lines per text, and the lines' lengths; a text without any line has one of length 1.

    A line's own features: shares of kinds of bytes; of words that are distinct, repeat the word before, end with a symbol, are symbols
    only; mean word length, number of words, how often the line came before in the text, whether it ends a sentence. Beside them stand their
    squares, the same of the line before and of the line behind (zero at the ends), and marks for the first and last line.
    """
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    raw = b"\n".join(parts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    line_ends = np.flatnonzero(data == 10)
    line_starts = np.append(0, line_ends[:-1] + 1)
    text_ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    text_of = np.searchsorted(text_ends, line_ends)
    space = _KINDS[4].astype(bool)[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    word_starts, word_ends = edge[0::2], edge[1::2]
    first_word = np.searchsorted(word_starts, line_starts)
    n_words = np.diff(np.append(first_word, len(word_starts)))
    full = n_words > 0
    missing = np.ones(len(parts), bool)
    missing[text_of[full]] = False
    full[np.searchsorted(text_of, np.flatnonzero(missing))] = True  # the first line of a blank text stands for it
    starts, ends, text_of, n_words = line_starts[full], line_ends[full], text_of[full], n_words[full]
    count = len(starts)
    length = np.maximum(1, ends - starts)
    many = np.maximum(1, n_words)

    def within(per_byte: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(per_byte, dtype=np.int64))
        return sums[ends] - sums[starts]

    kinds = [within(k[data]) / length for k in _KINDS]
    own = np.zeros((count, 14), np.float32)
    own[:, :6] = np.stack(kinds, 1)
    if len(word_starts):
        lower = np.frombuffer(raw.lower(), np.uint8)
        h = hashes_between(lower, word_starts, word_ends)
        line = np.repeat(np.arange(count), n_words)
        same = np.append(False, (h[1:] == h[:-1]) & (line[1:] == line[:-1]))
        order = np.lexsort((h, line))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1]))
        last = data[word_ends - 1]
        marked = _SYMBOL[last] & (last != 46) & (last != 44)
        letters = np.append(0, np.cumsum((~_SYMBOL & ~_KINDS[4].astype(bool))[data], dtype=np.int64))
        lone = letters[word_ends] == letters[word_starts]
        for k, values in ((7, same), (8, marked), (9, lone)):
            own[:, k] = np.bincount(line, values, count) / many
        own[:, 6] = np.bincount(line[order], new, count) / many
        final = np.minimum(np.cumsum(n_words) - 1, len(last) - 1)
        own[:, 13] = np.isin(last[final], (33, 46, 63)) & (n_words > 0)
    own[:, 10] = np.minimum(1, length / many / 12)
    own[:, 11] = np.log1p(n_words) / 8
    key = hashes_between(data, starts, ends) + mix(text_of.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    runs = np.append(True, key[order][1:] != key[order][:-1])
    place = np.arange(count) - np.maximum.accumulate(np.where(runs, np.arange(count), 0))
    own[order, 12] = np.minimum(3, place) / 3
    sizes = np.bincount(text_of, minlength=len(parts))
    first = np.append(True, text_of[1:] != text_of[:-1])
    last_line = np.append(first[1:], True)
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:], behind[:-1] = own[:-1], own[1:]
    before[first], behind[last_line] = 0, 0
    marks = np.stack([np.ones(count), first, last_line], 1).astype(np.float32)
    return np.concatenate([marks, own, own**2, before, behind], 1), sizes, length.astype(np.float64)


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(scores: np.ndarray, sizes: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the lines' labels, summed pair marginals (2 x 2), and log partition functions.

    `scores`: (lines, 2) of consecutive documents with `sizes` lines each; `move`: (2, 2) transition scores. Documents advance together,
    one line a step, the longest first.
    """
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    begins, lengths = begins[order], sizes[order]
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(int(lengths[0]))]  # documents longer than t lines
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[begins] = scores[begins]
    for t in range(1, len(active)):
        at = begins[: active[t]] + t
        f = forward[at - 1]
        for y in (0, 1):
            forward[at, y] = _log_sum(f[:, 0] + move[0, y], f[:, 1] + move[1, y]) + scores[at, y]
    ends = begins + lengths - 1
    z = np.empty(len(sizes))
    z[order] = _log_sum(forward[ends, 0], forward[ends, 1])
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = begins[: active[t]] + t
        own = scores[at] + backward[at]
        for x in (0, 1):
            backward[at - 1, x] = _log_sum(move[x, 0] + own[:, 0], move[x, 1] + own[:, 1])
        zt = z[order[: active[t]]]
        for x in (0, 1):
            for y in (0, 1):
                pairs[x, y] += np.exp(forward[at - 1, x] + move[x, y] + own[:, y] - zt).sum()
    marginals = np.exp(forward + backward - np.repeat(z, sizes)[:, None])
    return marginals, pairs, z


def latent_labels(scores: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, move: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of being good and the summed pair marginals, where each document's expected good share is as its label says.

    One offset per document, found by halving, moves its lines' scores; documents whose share fits anyway have none.
    """
    document = np.repeat(np.arange(len(sizes)), sizes)
    weight = lengths / np.add.reduceat(lengths, np.cumsum(sizes) - sizes)[document]

    def labelled(offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marginals, pairs, _ = forward_backward(np.stack([np.zeros(len(scores)), scores + offset[document]], 1), sizes, move)
        return marginals[:, 1], pairs, np.bincount(document, marginals[:, 1] * weight, len(sizes))

    lines, moves, part = labelled(np.zeros(len(sizes)))
    fits = np.where(good == 1, part >= GOOD_SHARE, part <= BAD_SHARE)
    if fits.all():
        return lines, moves
    target = np.where(good == 1, GOOD_SHARE, BAD_SHARE)
    low, high = np.full(len(sizes), -12.0), np.full(len(sizes), 12.0)
    for _ in range(12):
        middle = (low + high) / 2
        under = labelled(np.where(fits, 0, middle))[2] < target
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return labelled(np.where(fits, 0, (low + high) / 2))[:2]


class Crf:
    """Weights of the features for "good" against "bad", and of moves between labels."""

    def __init__(self, weights: np.ndarray, move: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.move, self.mean, self.scale = weights, move, mean, scale

    @staticmethod
    def fit(
        features: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, good: np.ndarray, steps: int = 150, penalty: float = 1e-3, rate: float = 0.1,
        latent_rounds: int = LATENT_ROUNDS,
    ) -> Crf:
        """Maximum likelihood by Adam; a document's lines together weigh as one.

        At first every line has its document's label. Then the lines' labels are latent: a document's label only says which share of its length is good, at
        least GOOD_SHARE or at most BAD_SHARE. In `latent_rounds` rounds the field labels the lines itself, moved by one offset for all lines of a
        document whose expected share is not as its label says, and learns from these labels and the moves between them.
        """
        mean, scale = features.mean(0), features.std(0) + 1e-3
        mean[0], scale[0] = 0, 1  # the constant
        x = ((features - mean) / scale).astype(np.float64)
        y = np.repeat(good, sizes)
        share = np.repeat(1 / sizes, sizes)
        hot = np.stack([1 - y, y], 1)
        inside = np.ones(len(y), bool)
        inside[np.cumsum(sizes) - sizes] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][inside[1:]].astype(int), y[1:][inside[1:]].astype(int)), 1)
        size = x.shape[1]

        def climb(w: np.ndarray, lines: np.ndarray, moves: np.ndarray, steps: int, rate: float) -> np.ndarray:
            m, v = np.zeros_like(w), np.zeros_like(w)
            for t in range(1, steps + 1):
                s = np.stack([np.zeros(len(x)), x @ w[:size]], 1)
                marginals, pairs, _ = forward_backward(s, sizes, w[size:].reshape(2, 2))
                g = np.concatenate([x.T @ ((lines - marginals[:, 1]) * share) / len(sizes), ((moves - pairs) / len(y)).ravel()]) - penalty * w
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            return w

        w = climb(np.zeros(size + 4), hot[:, 1], seen, steps, rate)
        for _ in range(latent_rounds):
            lines, moves = latent_labels(x @ w[:size], sizes, lengths, w[size:].reshape(2, 2), good)
            w = climb(w, lines, moves, steps // 5, rate / 2)
        return Crf(w[:size], w[size:].reshape(2, 2), mean, scale)

    def good_shares(self, features: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The lines' marginals, weighted by their lengths, of each document."""
        begins = np.cumsum(sizes) - sizes
        return (np.add.reduceat(self.marginals(features, sizes) * lengths, begins) / np.add.reduceat(lengths, begins)).clip(0, 1)

    def marginals(self, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        s = ((features - self.mean) / self.scale).astype(np.float64) @ self.weights
        return forward_backward(np.stack([np.zeros(len(s)), s], 1), sizes, self.move)[0][:, 1]

    def scores(self, texts: list[str | None]) -> list[float]:
        """Each text's quality: its lines' marginals, weighted by their lengths."""
        return self.good_shares(*line_features(texts)).tolist()


def held_out(id_text: F.Column) -> F.Column:
    """Rows whose label no training sees."""
    return F.crc32(id_text.cast("string").cast("binary")) % 4 == 2


def fit_quality(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents_at_most: int = TRAIN_DOCUMENTS,
    lines_at_most: int = TRAIN_LINES,
) -> Crf | None:
    """Trains on labelled documents that are not held out, `documents_at_most` of them (the smallest hashes of their ids), in that order while they have
    `lines_at_most` lines together. Whole documents: one that has more lines than are left is passed over.

    The sample is chosen among the labels, a repeated id counts once, with its smallest text; lines' features are made on the executors; they
    are what reaches the driver. Without rows of both labels there is nothing to learn: None.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("good")).filter("good is not null and id is not null")
    known = known.filter(~F.coalesce(held_out(F.col("id")), F.lit(False))).groupBy("id").agg(F.max("good").alias("good"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(documents_at_most)
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(known, "id")
    rows = rows.groupBy("id", "good").agg(F.min("text").alias("text"))
    n = F.size(F.split("text", "\n"))
    so_far = F.sum(F.when(n <= lines_at_most, n)).over(Window.orderBy(F.xxhash64("id"), "id"))  # at most documents_at_most rows
    rows = rows.withColumn("so_far", so_far).filter((n <= lines_at_most) & (F.col("so_far") <= lines_at_most)).drop("so_far")
    rows = stored(rows, "sample")

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(frames, "text"):
            x, sizes, lengths = line_features(part["text"].tolist())
            at = np.cumsum(sizes)[:-1]
            made, long = np.split(x, at), np.split(lengths, at)
            yield pd.DataFrame({
                "id": part["id"], "good": part["good"], "n": sizes, "x": [x.tobytes() for x in made], "long": [x.tobytes() for x in long]
            })

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInPandas(features, f"id {kind}, good int, n int, x binary, long binary").toPandas()
    discard(rows)
    if got["good"].nunique() < 2:
        return None
    got = got.sort_values(["id", "x"], ignore_index=True)
    x = np.concatenate([np.frombuffer(b, np.float32).reshape(n, -1) for b, n in zip(got["x"], got["n"])])
    lengths = np.frombuffer(b"".join(got["long"]), np.float64)
    return Crf.fit(x, got["n"].to_numpy(np.int64), lengths, got["good"].to_numpy(np.float64))


def score_quality(documents: DataFrame, model: Crf | None, text_col: str = "text") -> DataFrame:
    """All columns of `documents` and `score` (0 to 1), by the text alone; 0.5 for every text without a model.

    Null and blank texts are scored as one empty line. Nothing is shuffled.
    """
    if "score" in documents.columns:
        documents = documents.drop("score")
    if model is None:
        return documents.withColumn("score", F.lit(0.5))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            frame = series.to_frame("text")
            yield pd.Series([s for part in chunks([frame], "text") for s in model.scores(part["text"].tolist())], dtype="float64")

    return documents.withColumn("score", score(F.col(f"`{text_col}`")))
