"""The registered query of each operator, with the columns its contract names."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    curves, decontaminate, filter_audit, license_scan, line_dedup, ngram_join, packing, pii, quality, sql, substrings, token_counts, url_filter,
    vector_codes,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _package() -> str:
    """This package as an archive, for executors whose Python path lacks it."""
    root = Path(__file__).resolve().parents[2]
    return shutil.make_archive(f"{tempfile.mkdtemp()}/{Path(__file__).parents[1].name}", "zip", root, Path(__file__).parents[1].name)


@functools.cache
def _ship(application: str, spark: SparkSession) -> None:
    spark.sparkContext.addPyFile(_package())


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, after the session's executors have been given this package."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        _ship(spark.sparkContext.applicationId, spark)
        return query(spark, *args)

    return run


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token across a line's end counts where most of it is."""
    return token_counts.section_tokens(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later occurrences of repeated windows of lines."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 4-word shingles reach a similarity of 0.85."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), 4, 85, 100)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans; n_found counts what contexts added."""
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", pii.of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"),
        pii.spelled(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_found"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a field trained without the held-out quarter."""
    documents, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    scored = quality.score_quality(documents, quality.fit_quality(documents, labels))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    return curves.nearest(_table(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), 2048)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds."""
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that start in a document with a smaller id too."""
    done = substrings.dedup_substrings(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters does at each step of all their orders, by source."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of eight parts for all vectors, by codebooks of 16 entries after six rounds."""
    done = vector_codes.encode_vectors(_table(spark, sf_dir, "embeddings"))
    return done.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.sha2("codebooks", 256).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: shipped(f)
        for f in (
            op1_url_filter, op2_token_counts, op3_line_dedup, op4_ngram_join, op5_pii, op6_quality, op7_license_scan, op8_nearest,
            op9_best_fit_packing, op10_decontamination, op11_substring_dedup, op12_filter_audit, op13_vector_codes,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_substring_dedup": sql.SUBSTRING_DEDUP, "op12_filter_audit": sql.FILTER_AUDIT, "op13_vector_codes": sql.vector_codes()}
