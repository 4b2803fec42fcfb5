"""The corpus pipeline: each stage and the whole against plain versions."""

import random

import corpus_pipeline
import pytest
from hemtally.llm import quality

from . import brute
from .test_ngram_join import brute as near_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good and bad documents, copies, near copies, repeated lines, benchmark passages, nulls and repeated rows."""
    r = random.Random(11)
    words = [f"{a}{b}" for a in ("sun", "sea", "hill", "road", "tree", "bird", "lake") for b in ("side", "line", "way", "light", "field")]
    sentence = lambda: " ".join(r.choice(words) for _ in range(r.randint(8, 16))).capitalize() + "."
    items = [(i, " ".join(r.choice(words) for _ in range(20))) for i in range(4)]
    footer = "\n".join(sentence() for _ in range(3))
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        lines = ["### $$$ %%% !!! 123 " * r.randint(2, 5) for _ in range(4)] if bad else [sentence() for _ in range(r.randint(3, 8))]
        if not bad and i % 9 == 0:
            lines.append(footer)
        if not bad and i % 13 == 0:
            lines.insert(1, items[i % 4][1])
        if i % 2 == 0 or i < 40:
            labels.append((i, int(not bad), 0))
        rows.append((i, "\n".join(lines)))
    for i in range(160, 190):
        w = rows[r.choice([1, 2, 3, 5, 6, 7])][1].split(" ")
        if i % 2:
            w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "  \n \n"), rows[1], (503, "\n".join([footer, footer]))]
    folder = str(tmp_path_factory.mktemp("corpus"))
    full = [(i, t, "en", "s" if i % 3 else None, None if t is None else len(t)) for i, t in rows]
    documents = spark.createDataFrame(full, SCHEMA)
    for name, df in (
        ("documents", documents),
        ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")),
        ("benchmark", spark.createDataFrame(items, "item_id long, text string")),
    ):
        df.write.parquet(f"{folder}/{name}.parquet")
    return documents, full, items, folder


def taken(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_quality_keeps_what_scores_high_enough(spark, corpus):
    documents, full, _, folder = corpus
    got = STAGES["quality"](spark, documents, folder)
    assert got.columns == documents.columns
    model = quality.fit_quality(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = dict(zip([r[1] for r in full], model.scores([r[1] for r in full])))
    assert taken(got) == sorted((r for r in full if scores[r[1]] >= quality.THRESHOLD), key=str)
    kept = {r[0] for r in taken(got)}
    assert not any(i % 4 == 0 for i in kept if i < 160) and sum(i % 4 != 0 for i in kept if i < 160) == 120


def test_quality_without_labels_keeps_all(spark, corpus, tmp_path):
    documents, full, _, _ = corpus
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert taken(STAGES["quality"](spark, documents, str(tmp_path))) == sorted(full, key=str)


def test_line_dedup_drops_what_is_left_blank(spark, corpus):
    documents, full, _, folder = corpus
    got = STAGES["line_dedup"](spark, documents, folder)
    plain = {}
    for i, (text, n) in brute.deduped(list(dict.fromkeys((r[0], r[1]) for r in full))).items():
        plain[i] = (text, n)
    expected = []
    for i, t, lang, source, n_chars in full:
        text, n = plain[i]
        if n == 0 or text.strip():
            expected.append((i, text, lang, source, n_chars if n == 0 else len(text)))
    assert taken(got) == sorted(expected, key=str) and got.columns == documents.columns


def test_near_duplicates_leave_one_of_a_group(spark, corpus):
    documents, full, _, folder = corpus
    got = STAGES["near_duplicates"](spark, documents, folder)
    groups = near_groups([(r[0], r[1], r[3]) for r in full], 5, 80, 100)
    expected = {i for i, _, group in groups if i == group}
    assert taken(got) == sorted({r for r in full if r[0] in expected}, key=str)


def test_decontamination_drops_what_holds_an_item(spark, corpus):
    documents, full, items, folder = corpus
    got = STAGES["decontamination"](spark, documents, folder)
    squeeze = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    clean = [r for r in full if not any(brute.edits_within(squeeze(t), squeeze(r[1])) <= len(squeeze(t)) // 10 for _, t in items)]
    assert taken(got) == sorted(clean, key=str) and len(clean) < len(full)


def test_run_applies_all_stages(spark, corpus):
    documents, full, _, folder = corpus
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect() or [], stage(spark, docs, folder).schema)
    got = corpus_pipeline.run(spark, folder)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert taken(got.select(columns)) == taken(docs.select(columns)) != []


def test_empty_tables(spark, corpus, tmp_path):
    documents, _, _, folder = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), folder).collect() == [], name
