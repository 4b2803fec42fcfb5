"""Token counts by offset-mapped attribution."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encoder
from .shared import chunks

RULES = ("first", "most", "split")


def section_tokens(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    separator: str = "\n",
    rule: str = "most",
    vocabulary: str | None = None,
) -> DataFrame:
    """Tokens of each section of each document: (doc_id, section, start, length, n_tokens, n_inside, n_crossing, doc_tokens).

    A section is what stands between separators (one ASCII character), the separator that ends it included; sections are numbered
    from 0, `start` and `length` are in bytes of UTF-8. The whole document is encoded once; the byte spans of its tokens are joined
    with the sections' intervals by a merge of two sorted lists. A token inside one section counts there. One that crosses a
    boundary is allocated by `rule`: "first", the section of its first byte; "most", the section with most of its bytes, the
    earliest of equals; "split", to each section the share of its bytes (n_tokens is then fractional). So the sections' n_tokens
    always add up to doc_tokens. n_inside counts tokens wholly inside; n_crossing, boundary-crossing tokens that touch the section.

    One output row per section, even without tokens: a null or empty text has one section of length 0. Repeated rows give repeated
    results. Nothing is shuffled: texts of about a million characters at a time, or one longer text, pass through a worker.
    """
    if rule not in RULES or len(separator.encode()) != 1:
        raise ValueError(f"rule must be one of {RULES}, separator one ASCII character")
    key = ord(separator)

    def attribute(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(vocabulary, added=True)
        for rows in chunks(frames, "text"):
            texts = rows["text"].tolist()
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            for text, ids in zip(texts, code.batch(texts)):
                data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
                stops = np.append(np.flatnonzero(data == key) + 1, len(data))  # a section ends behind its separator
                if len(stops) > 1 and stops[-1] == stops[-2]:
                    stops = stops[:-1]
                for column, part in zip(columns, _attribute(code.widths[ids], stops, rule)):
                    column.append(part)
            counts = [len(c) for c in columns[0]]
            out = {n: np.concatenate(c) for n, c in zip(("section", "start", "length", "n_tokens", "n_inside", "n_crossing", "doc_tokens"), columns)}
            yield pd.DataFrame({"id": rows["id"].repeat(counts).to_numpy()} | out)

    kind = documents.schema[id_col].dataType.simpleString()
    number = "double" if rule == "split" else "long"
    schema = f"id {kind}, section long, start long, length long, n_tokens {number}, n_inside long, n_crossing long, doc_tokens long"
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(attribute, schema).withColumnRenamed("id", id_col)


def _attribute(widths: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, ...]:
    """Per section: number, start, length, tokens by the rule, tokens inside, tokens crossing, tokens of the document."""
    n = len(stops)
    begins = np.concatenate([[0], stops[:-1]])
    ends = np.cumsum(widths)
    starts = ends - widths
    first = np.minimum(np.searchsorted(stops, starts, "right"), n - 1)
    last = np.minimum(np.searchsorted(stops, ends - 1, "right"), n - 1)
    inside = np.bincount(first[first == last], minlength=n)
    tokens = inside.astype(np.float64) if rule == "split" else inside.copy()
    crossing = np.zeros(n, np.int64)
    for t in np.flatnonzero(first != last):
        touched = np.arange(first[t], last[t] + 1)
        share = np.minimum(ends[t], stops[touched]) - np.maximum(starts[t], begins[touched])
        crossing[touched] += 1
        if rule == "split":
            tokens[touched] += share / widths[t]
        else:
            tokens[touched[0 if rule == "first" else int(np.argmax(share))]] += 1
    return np.arange(n), begins, stops - begins, tokens, inside, crossing, np.full(n, len(widths))
