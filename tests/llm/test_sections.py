"""Tokens of every section against a plain attribution by the tokenizer's own tokens."""

from collections import defaultdict

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

from hemtally.llm import queries

SF = "/root/testdata/sf0.001"


def attributed(tokenizer, text):
    """Tokens per line: each where most of its bytes are, of two equal halves the first."""
    lines = text.encode().split(b"\n")
    ends, at = [], 0
    for n, line in enumerate(lines):
        at += len(line) + (n < len(lines) - 1)
        ends.append(at)
    counts, begin = [0] * len(ends), 0
    for i in tokenizer.encode(text, add_special_tokens=False).ids:
        end = begin + len(tokenizer.id_to_token(i))  # a character of its spelling for each byte
        inside = [max(0, min(end, e) - max(begin, s)) for s, e in zip([0, *ends], ends)]
        counts[inside.index(max(inside))] += 1
        begin = end
    return counts


def test_every_line_has_its_own_tokens(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in queries.queries()["op2_token_counts"](spark, SF).collect():
        got[r["doc_id"]].append((r["section"], r["n_tokens"]))
    documents = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' where length(text) < 20000").fetchall()
    assert len(documents) > 100
    for i, text in documents:
        expected = attributed(tokenizer, text)
        if text.endswith("\n"):
            expected = expected[:-1]  # nothing behind the last line's end
        assert [n for _, n in sorted(got[i])] == expected, i
