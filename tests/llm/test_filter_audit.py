"""The filter audit against a plain version that applies every order to every document."""

import itertools
import random
import re

from pyspark.sql import functions as F

from hemtally.llm.filter_audit import FIELD, ORDERS, STATISTICS, audit, outcome

from .test_edges import clashing

DOCUMENTS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def failing(rows, i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        "D": bool(set("#$%&*|") & set(text)), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
    }


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {s or "" for *_, s in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step in range(1, 6):
                out[part, order, step] = dict.fromkeys((*STATISTICS, "shapley"), 0)
    for i, text, source in rows:
        fails = failing(rows, i, text or "")
        for order in map("".join, itertools.permutations("ABCDE")):
            lost = False
            for step, f in enumerate(order, 1):
                x = out[source or "", order, step]
                here = fails[f] and not lost
                x["removed"] += here
                x["redundant"] += fails[f] and lost
                x["good_lost"] += here and i in good
                x["toxic_lost"] += here and i in toxic
                x["unique_fails"] += fails[f] and sum(fails.values()) == 1
                lost = lost or fails[f]
                x["kept"] += not lost
    for part, order, step in out:
        f = order[step - 1]
        out[part, order, step]["shapley"] = sum(out[part, o, o.index(f) + 1]["removed"] for o in ORDERS)
    return out


def got(documents, labels):
    return {(r["part"], r["filter_order"], r["step"]): {k: r[k] for k in (*STATISTICS, "shapley")} for r in audit(documents, labels).collect()}


def texts(r):
    words = [f"w{i}" for i in range(300)]
    out = [None, "", " \n\t", "#", "A", "ÄÖ x" * 300, "\n".join(r.sample(words, 250)), " ".join(r.sample(words, 250)) + " 5%", "same " * 400]
    for _ in range(12):
        w = [r.choice(words[: r.choice([60, 300])]) for _ in range(r.choice([5, 199, 200, 201, 400]))]
        w = [x.upper() if r.random() < r.choice([0, 0.1]) else x for x in w]
        out.append(" ".join(w) + r.choice(["", "|", "*"]))
    return out


def test_same_as_brute_force(spark):
    r = random.Random(2)
    pool = texts(r)
    rows = [(r.choice([None, *range(60)]), r.choice(pool), r.choice([None, "", "a", "b"])) for _ in range(120)]
    rows += [rows[0], (7, "x" * 5000 + " " + "y z " * 40_000, "c")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(50)] + [(3, 1, 1), (None, 1, 1), (999, 1, 1)]
    documents = clashing(spark.createDataFrame(rows, DOCUMENTS)).repartition(5)
    assert got(documents, clashing(spark.createDataFrame(labels, LABELS))) == brute(rows, labels)


def test_empty_tables(spark):
    documents, labels = spark.createDataFrame([(1, "a", "s")], DOCUMENTS), spark.createDataFrame([], LABELS)
    assert audit(documents.limit(0), labels).collect() == []
    assert got(documents, labels) == brute([(1, "a", "s")], [])


def test_many_parts(spark, monkeypatch):
    documents = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.concat(F.lit("s"), F.col("id") % 650).alias("source"))
    result = audit(documents, spark.createDataFrame([], LABELS)).filter("filter_order = 'EABCD' and step = 2").agg(F.count("*"), F.sum("removed")).first()
    assert tuple(result) == (650, 1)  # the first id's text is the others' too


def test_fields_do_not_run_over():
    total = outcome(31, True, True) * ((1 << 63) - 1) + outcome(0, False, False)
    fields = [total >> (8 * FIELD * i) & ((1 << 64) - 1) for i in range(3600)]
    assert set(fields) == {0, 1, (1 << 63) - 1} and total < 1 << (8 * FIELD * 3600)
