"""A corpus pipeline: quality, line deduplication, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; `run` writes each stage's rows to the shared
folder and rereads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemtally.llm import decontaminate, line_dedup, ngram_join, packing, quality
from hemtally.llm.shared import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly good; the model learns from this stage's own documents that are labelled."""
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    if model is None:  # nothing to learn from, nothing to reject
        return docs
    return quality.score_quality(docs, model).filter(F.col("score") >= quality.THRESHOLD).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated windows; those of which nothing remains go. n_chars follows the text."""
    done = line_dedup.dedup_lines(docs)
    done = done.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return done.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("items") == 0).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces in sequences of 2048 tokens."""
    return packing.pack_documents(docs, 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Training and alignment have no SQL form; tests/llm/test_pipeline.py holds each stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
