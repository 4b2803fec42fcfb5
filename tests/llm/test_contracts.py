"""The registered queries over whole tables against plain versions."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hemtally.llm import queries

from . import brute

SF = "/root/testdata/sf0.01"
QUERIES = queries.queries()


@pytest.fixture(scope="module")
def table():
    return lambda name, columns="*": duckdb.sql(f"select {columns} from '{SF}/{name}.parquet'").fetchall()


def result(spark, name, key="doc_id"):
    return {r[key]: r.asDict() for r in QUERIES[name](spark, SF).collect()}


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_op1(spark, table):
    got = result(spark, "op1_url_filter", "page_id")
    pages = table("pages", "page_id, url")
    assert len(got) == len(pages)
    for i, url in pages:
        host, path, rule, verdict = brute.host_path_rule(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")


def test_op2(spark, table, tokenizer):
    got = defaultdict(list)
    for r in QUERIES["op2_token_counts"](spark, SF).collect():
        got[r["doc_id"]].append(r)
    documents = table("documents", "doc_id, text")
    assert set(got) == {i for i, _ in documents}
    for i, text in documents:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        sections = sorted(got[i], key=lambda r: r["section"])
        assert {r["doc_tokens"] for r in sections} == {len(ids)} and sum(r["n_tokens"] for r in sections) == len(ids)
        assert b"".join(text.encode()[r["start"] : r["start"] + r["length"]] for r in sections) == text.encode()


def test_op3(spark, table):
    got = result(spark, "op3_line_dedup")
    for i, (text, removed) in brute.deduped(table("documents", "doc_id, text")).items():
        assert (got[i]["text"], got[i]["n_removed"]) == (text, removed)


def test_op5(spark, table):
    got = result(spark, "op5_pii")
    kinds = ("email", "ip", "card", "phone")
    for i, text in table("documents", "doc_id, text"):
        spans = brute.base_spans(text)
        spelled = [f"{kinds[k]}:{a}:{b}" for a, k, b in spans]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(s[1] == n for s in spans) for n in range(4)]
        assert set(spelled) <= set(got[i]["spans"].split(","))
        assert len(got[i]["spans"].split(",")) == len(spelled) + got[i]["n_found"] or not got[i]["spans"]


def test_op6(spark, table):
    got = result(spark, "op6_quality")
    labels = dict(table("labels", "doc_id, quality"))
    assert len(got) == len(table("documents", "doc_id"))
    right = []
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["held_out"] and i in labels:
            right.append(r["predicted"] == labels[i])
    assert len(right) > 50 and np.mean(right) > 0.95


def test_op7(spark, table):
    got = result(spark, "op7_license_scan")
    for i, text in table("documents", "doc_id, text"):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licenses(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op8(spark, table):
    rows = [(i, v) for i, v in table("embeddings", "vec_id, embedding")]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = defaultdict(dict)
    for r in QUERIES["op8_nearest"](spark, SF).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = []
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(np.square(x - x[q]).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != q][:10]
        found = got[ids[q]]
        assert sorted(found) == list(range(1, 11))
        assert [found[k] for k in sorted(found)] == sorted(found.values(), key=lambda f: (f[1], f[0]))
        for vec, score in found.values():
            assert score == d[np.flatnonzero(ids == vec)[0]]
        hits.append(len({v for v, _ in found.values()} & {ids[j] for j in order}) / 10)
    assert len(hits) == len(got) and np.mean(hits) >= 0.9


def test_op9(spark, table, tokenizer):
    pieces = [r.asDict() for r in QUERIES["op9_best_fit_packing"](spark, SF).collect()]
    of = defaultdict(list)
    sequences = defaultdict(list)
    for p in pieces:
        of[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    lengths = []
    documents = table("documents", "doc_id, text")
    assert set(of) == {i for i, _ in documents}
    for i, text in documents:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for n, p in enumerate(sorted(of[i], key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (n, at) and (n == 0 or p["length"] == 2048)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
            lengths.append(p["length"])
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == sum(brute.bins_of_best_fit(lengths, 2048).values())


def test_op10(spark, table):
    got = result(spark, "op10_decontamination")
    items = table("benchmark", "item_id, text")
    holds = {i: [k for k, b in items if b in text] for i, text in table("documents", "doc_id, text")}
    assert any(holds.values()) and len(got) == len(holds)
    for i, found in holds.items():
        assert set(found) <= set(got[i]["items"]) and got[i]["contaminated"] == bool(got[i]["items"])
    extra = [i for i in got if got[i]["items"] and not holds[i]]
    assert len(extra) < 0.01 * len(got)
