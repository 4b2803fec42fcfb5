"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hemtally.llm import curves, decontaminate, encode, license_scan, line_dedup, packing, pii, quality, shared, token_counts, url_filter
from hemtally.llm.words import shingle_sets

from . import brute

SCHEMA = "doc_id long, text string"
LONG = " ".join(f"word{i % 977}" for i in range(150_000))


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def clashing(df):
    """The table with columns named like those that operators use inside."""
    names = "id th row h n v seen base found items score key a b sid label _bucket _n length template parts host rule".split()
    return df.select("*", *(F.lit(1).alias(n) for n in names if n not in df.columns))


def test_token_counts(spark):
    df = docs(spark, None, "", "a\nb\n", "\n\n", "one two\nthree", LONG)
    got = token_counts.section_tokens(clashing(df)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.max("doc_tokens").alias("d"))
    got = {r["doc_id"]: r for r in got.collect()}
    assert {i: r["n"] for i, r in got.items()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2, 5: 1}
    assert all(r["t"] == r["d"] for r in got.values()) and got[5]["d"] > 150_000
    assert token_counts.section_tokens(df.limit(0)).collect() == []


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_a_token_across_a_boundary_is_allocated_by_the_rule(rule):
    widths, stops = np.array([2, 6, 2]), np.array([4, 10])  # the second token has bytes 2 to 8
    _, _, _, tokens, inside, crossing, total = token_counts._attribute(widths, stops, rule)
    assert tokens.tolist() == {"first": [2, 1], "most": [1, 2], "split": [1 + 2 / 6, 1 + 4 / 6]}[rule]
    assert (inside.tolist(), crossing.tolist(), total.tolist()) == ([1, 1], [1, 1], [3, 3])
    even = token_counts._attribute(np.array([4]), np.array([2, 4]), rule)[3].tolist()
    assert even == {"first": [1, 0], "most": [1, 0], "split": [0.5, 0.5]}[rule]


def test_line_dedup(spark):
    long = " ".join(["w"] * 60)
    rows = [
        (2, "a\nb\nc\nown"), (1, "a\n b \n\nc\nd"), (3, long), (4, f"x\n{long}\ny"), (5, None), (6, ""), (7, "a\nb"), (2, "a\nb\nc\nown"),
        (8, "q\nq\nq\nq\nq"), (None, "m\nn\no"), (9, "m\nn\no"),
    ]
    got = line_dedup.dedup_lines(clashing(spark.createDataFrame(rows, SCHEMA)))
    assert "template" in got.columns
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()), key=str)
    expected = [
        (1, "a\n b \n\nc\nd", 0), (2, "own", 3), (2, "own", 3), (3, long, 0), (4, "x\ny", 1), (5, None, 0), (6, "", 0), (7, "a\nb", 0),
        (8, "q", 4), (9, "", 3), (None, "m\nn\no", 0),
    ]
    assert got == sorted(expected, key=str)
    assert line_dedup.dedup_lines(docs(spark).limit(0)).collect() == []


def test_line_dedup_keeps_a_copy_of_every_line(spark):
    r = random.Random(3)
    rows = [(i, "\n".join(r.choice("abcd") for _ in range(r.randint(0, 12)))) for i in range(80)]
    got = {x["doc_id"]: (x["text"], x["n_removed"]) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute.deduped(rows)
    assert {x for t, _ in got.values() for x in t.split("\n")} >= {x for _, t in rows for x in t.split("\n")}


def test_decontamination_finds_what_plain_alignment_finds(spark):
    r = random.Random(1)
    letters = "abcdefgh"
    items = [(i, "".join(r.choice(letters) for _ in range(r.choice([5, 9, 10, 14, 19, 24, 29, 35, 39] if i > 5 else range(40, 120))))) for i in range(16)]
    rows = [(0, None), (1, ""), (2, "too short")]
    for i in range(3, 60):
        b = list(r.choice(items)[1])
        for _ in range(r.randint(0, max(2, len(b) // 9))):
            at = r.randrange(len(b))
            b[at : at + r.randint(0, 1)] = r.choice(["", r.choice(letters)])
        rows.append((i, "".join(r.choice(letters) for _ in range(r.randint(0, 150))) + "".join(b).upper() + "".join(r.choice(letters) for _ in range(50))))
    benchmark = spark.createDataFrame([*items, items[0], (70, None), (80, "tiny"), (90, "?!"), (None, items[1][1])], "item_id long, text string")
    for block in (150, 10**6):
        got = decontaminate.contaminated(clashing(spark.createDataFrame(rows, SCHEMA)), clashing(benchmark), block_chars=block)
        for x in got.collect():
            text = (dict(rows)[x["doc_id"]] or "").lower().replace(" ", "")
            assert x["items"] == [i for i, t in items if brute.edits_within(t, text) <= int(len(t) * 0.1)]
    assert decontaminate.contaminated(docs(spark, "a"), benchmark.limit(0)).first()["items"] == []


def test_packing(spark):
    df = docs(spark, None, "", "a b c", LONG, "a b c")
    df = clashing(df.union(df.limit(3)).union(spark.createDataFrame([(None, "x")], SCHEMA)))
    got = packing.pack_documents(df, 64).collect()
    whole = 150_000 // 64
    assert sum(r["doc_id"] == 3 for r in got) > whole and sum(r["doc_id"] == 0 for r in got) == 2
    at = {}
    for s, o, n in sorted((r["sequence_id"], r["offset"], r["length"]) for r in got):
        assert at.setdefault(s, 0) == o
        at[s] += n
    assert max(at.values()) <= 64
    assert packing.pack_documents(docs(spark).limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_a_plan_over_counts_is_best_fit_over_pieces(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 2048])
    lengths = r.sample(range(1, capacity + 1), r.randint(1, min(capacity, 40)))
    histogram = {n: r.randint(1, 60) for n in lengths}
    slots = packing.plan_best_fit(histogram, capacity)
    filled = {}
    for n, _, ranks, first, sequences, _ in slots:
        for i in range(ranks):
            filled[first + i % sequences] = filled.get(first + i % sequences, 0) + n
    assert sum(k for *_, k, _, _, _ in slots) == sum(histogram.values())
    assert brute.bins_of_best_fit([n for n, c in histogram.items() for _ in range(c)], capacity) == pd.Series([capacity - f for f in filled.values()]).value_counts().to_dict()


def test_encoding_is_that_of_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["a  b", "x  \n\n y", "\n", "  ", "a\t\tb c", "<|endoftext|> k", "\n\n\nab\n", "don't  'll \n", "a" * 3000, "caf\u00e9 \u65e5\u672c \u3000 z", "", None, "\x85 a \xa0b", "\r\n q"]
    for own in (encode.encoder(), encode.Encoder(public_tokenizers.path("byte_bpe_50k.json"))):
        for text, ids in zip(texts, own.batch(texts)):
            assert ids.tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_quality(spark):
    labelled = [(i, ("good words here.\n" if i % 2 else "### $$$ ### %%%\n") * 3, 5) for i in range(60)]
    rows = [*labelled, (90, None, 5), (91, "", 5), (92, LONG, 5), (None, "some words", 5)]
    df = clashing(spark.createDataFrame(rows, SCHEMA + ", n_chars int"))
    labels = clashing(spark.createDataFrame([*((i, i % 2) for i in range(60)), (7, 1), (8, None), (None, 1)], "doc_id long, quality int"))
    model = quality.fit_quality(df, labels)
    got = quality.score_quality(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= 0.7) == bool(r["doc_id"] % 2) for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    assert quality.fit_quality(df, labels.limit(0)) is None and quality.score_quality(df.limit(0), model).collect() == []
    assert {r["score"] for r in quality.score_quality(df, None).collect()} == {0.5}


def test_quality_marginals_are_those_of_all_labellings():
    r = np.random.default_rng(0)
    sizes, move = np.array([3, 1, 4]), r.normal(size=(2, 2))
    scores = r.normal(size=(8, 2))
    got, pairs, z = quality.forward_backward(scores, sizes, move)
    at = 0
    for d, n in enumerate(sizes):
        own = scores[at : at + n]
        weight = {}
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            weight[tuple(y)] = np.exp(sum(own[i, y[i]] for i in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:])))
        total = sum(weight.values())
        assert np.isclose(z[d], np.log(total))
        for i in range(n):
            assert np.isclose(got[at + i, 1], sum(w for y, w in weight.items() if y[i]) / total)
        at += n
    assert np.isclose(pairs.sum(), (sizes - 1).sum())


def test_personal_data(spark):
    texts = [
        None, "", "a@b.c_d@e.f.g x.y@z", "1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (706) 555-3138 +12 +1(((((((",
        "\U0001f600 me@x.org", "1" * 4_000, "9." * 2_000, "a@" + "b." * 2_000, LONG, "1 2 3", "@", "x@y.z " * 300,
    ]
    got = {r["doc_id"]: r for r in pii.personal_data(clashing(docs(spark, *texts, *texts[2:4]))).collect()}
    for i, text in enumerate([*texts, *texts[2:4]]):
        assert [tuple(s) for s in got[i]["base"]] == brute.base_spans(text)
    assert pii.personal_data(docs(spark).limit(0)).collect() == []


def test_personal_data_learns_contexts(spark):
    known = [f"please write to user{i}@mail.example.com soon" for i in range(12)]
    texts = [*known, "please write to hidden@intranet soon", "nothing like hidden2@intranet here", "call 5 times"]
    got = {r["doc_id"]: [tuple(s) for s in r["found"]] for r in pii.personal_data(docs(spark, *texts)).collect()}
    assert got.pop(12) == [(16, 0, 31)]
    assert not any(got.values())


def test_license_scan(spark):
    texts = [
        None, "", "MIT License, mit-license", "the Apache License, Version 2.0", "GNU General Public License, version 3", "CC BY-NC 4.0", LONG,
        "SPDX-License-Identifier: BSD-3-Clause", "general public license general public license",
    ]
    got = [r for r in sorted(license_scan.scan_licenses(clashing(docs(spark, *texts))).collect(), key=lambda r: r["doc_id"])]
    for r, text in zip(got, texts):
        assert tuple(r)[1:6] == brute.licenses(text)
    assert [r["labels"] for r in got] == ["", "", "mit", "apache,apache-2.0", "gpl,gpl-3.0", "cc-by-nc-4.0", "", "bsd-3-clause", "gpl"]
    assert license_scan.scan_licenses(docs(spark).limit(0)).collect() == []
    assert len(license_scan.rules()) > 300


def test_nearest(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).tolist(), 1) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(40)]  # copies: ties by the smaller id
    rows += [(2000, None, 1), (2100, [0.0] * 8, 1), (2200, [1.0, None] * 4, 1), (2300, [float("nan")] * 8, 1), (2400, [float("inf")] + [0.0] * 7, 1), (None, rows[1][1], 1), (5, rows[5][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key int")
    got = {}
    for x in curves.nearest(df, share=0.6).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert set(got) == {0, 100, 200, 1000}
    assert [v for _, v, _ in sorted(got[0])] == list(range(1000, 1010)) and {s for *_, s in got[0]} == {0.0}
    assert [v for _, v, _ in sorted(got[1000])] == [0, *range(1001, 1010)]
    x = np.array([v for _, v, _ in rows[:300]], np.float32).astype(np.float64)
    best = np.argsort(np.square(x - x[100]).sum(1))[1:11]
    assert len({v for _, v, _ in got[100]} & set(best.tolist())) >= 9 or got[100][0][1] >= 1000
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in curves.nearest(few).collect()] == [(0, 1, 1, 1.0)]
    assert curves.nearest(few.limit(0)).collect() == []


def test_hilbert_keys_step_by_one():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        key = curves.hilbert_keys(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://EXAMPLE.org/es/x?y#z", "http://a.example.org/en/12", "https://x.com/fr/1", "x://y.com/de/", "http://com", "http://h.net?q/p",
        "http://h.net/a//b/c/d/e/f/g/h/i", "a://b://c/d", "http://notexample.org/es/", *(f"http://big.net/u/name{i}/posts" for i in range(60)),
        *(f"http://s.com/de/{i}" for i in range(30)), "http://s.com/xx/9",
    ]
    df = clashing(spark.createDataFrame(list(enumerate(urls + urls[:5])), "page_id long, url string"))
    got = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    assert len(got) == len(urls) + 5
    for i, url in enumerate(urls):
        host, path, rule, verdict = brute.host_path_rule(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule) and (verdict is None or got[i]["verdict"] == verdict)
    assert got[20]["template"] == "/u/*/posts" and got[20]["verdict"] == "allow"
    assert url_filter.judge_urls(df.limit(0)).collect() == []


def test_templates_are_rejected_by_labelled_purity(spark):
    urls = [f"http://s.com/de/{i}" for i in range(40)] + ["http://t.net/de/7", "http://t.net/fr/7"] + [f"http://s.com/fr/{i}" for i in range(40)]
    got = {r["host"] + r["path"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got["t.net/de/7"] == "block" and got["t.net/fr/7"] == "allow"


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {tuple(r) for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(30)}


def test_shingles_of_very_long_and_odd_texts():
    sets = shingle_sets([LONG, None, "", "a\xa0b \u2003c", "A b C d", "a B c D"], 4)
    assert [len(s) for s in sets] == [977, 0, 0, 1, 1, 1] and (sets[4] == sets[5]).all()
