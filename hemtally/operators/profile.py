"""Row and distinct-value counts of an arbitrary file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The logarithm of a sketch's size: a standard error of 0.8 %.
LG_SIZE = 14


def profile_file(df: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    """Per column: rows of the file and distinct non-NULL values, as ``[column, n_rows, n_distinct]``.

    The columns are turned into (column, value) rows and counted in two steps, so a value that fills a third of the
    file is already combined before the shuffle. ``approx_rsd`` swaps the distinct count for a sketch of that
    relative error, which shuffles one small row per column and task. A file without rows gives zero counts.
    """
    columns = df.columns
    values = _values(df, columns)
    if approx_rsd is not None:
        counts = values.groupBy("column").agg(
            F.count("*").alias("n_rows"), F.approx_count_distinct("value", approx_rsd).alias("n_distinct")
        )
    else:
        counts = (
            values.groupBy("column", "value")
            .agg(F.count("*").alias("n"))
            .groupBy("column")
            .agg(F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct"))
        )
    zeros = df.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, columns))).alias("column"),
        F.lit(0).cast("long").alias("n_rows"),
        F.lit(0).cast("long").alias("n_distinct"),
    )
    return (
        counts.unionByName(zeros)
        .groupBy("column")
        .agg(F.max("n_rows").alias("n_rows"), F.max("n_distinct").alias("n_distinct"))
    )


def profile_sketches(df: DataFrame, part: str, lg_size: int = LG_SIZE) -> DataFrame:
    """``[<part>, column, n_rows, sketch]``: what a part of a growing table, such as a day, contributes to its profile. To be kept and merged.

    ``part`` is not profiled itself. A sketch takes up to 2 ** ``lg_size`` bytes, whatever the part holds; values are shuffled nowhere.
    """
    columns = [c for c in df.columns if c != part]
    values = _values(df, columns, part)
    return values.groupBy(part, "column").agg(F.count("*").alias("n_rows"), F.hll_sketch_agg("value", lg_size).alias("sketch"))


def merged_profile(sketches: DataFrame, lg_size: int = LG_SIZE) -> DataFrame:
    """``[column, n_rows, n_distinct, n_least, n_most]`` of all parts together, whatever values they share.

    The bounds are three standard errors of the sketches' size around the estimate, so about 1 of 400 exact counts lies outside.
    """
    error = 3 * 1.04 / F.sqrt(F.pow(F.lit(2.0), F.lit(lg_size)))
    merged = sketches.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct")
    )
    return merged.withColumns(
        {"n_least": F.floor(F.col("n_distinct") / (1 + error)), "n_most": F.ceil(F.col("n_distinct") / (1 - error))}
    )


def _values(df: DataFrame, columns: Sequence[str], *kept: str) -> DataFrame:
    """One row per cell of ``columns``."""
    texts = df.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"`{c}`").cast("string").alias(c) for c in columns))
    return texts.unpivot([f"`{c}`" for c in kept], [f"`{c}`" for c in columns], "column", "value")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """Any ``n`` rows to look at."""
    return df.limit(n)
