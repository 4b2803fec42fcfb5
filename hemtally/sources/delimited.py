"""Headerless delimited files, read with an explicit column list. Every column is a string."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemtally.functions.dates import as_day


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str],
    sep: str = "\t",
    malformed: str | None = None,
) -> DataFrame:
    """One or many paths, wildcards allowed. ``columns`` names the fields in file order, from the first one on.

    Only the fields that a query uses are parsed. ``malformed`` names an extra column that keeps the text of lines
    whose field count is not ``len(columns)``; asking for it turns that pruning off.
    """
    fields = [T.StructField(name, T.StringType()) for name in columns]
    reader = spark.read.option("sep", sep)
    if malformed:
        fields.append(T.StructField(malformed, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", malformed).option("columnPruning", "false")
    return reader.schema(T.StructType(fields)).csv(paths if isinstance(paths, str) else list(paths))


def malformed_rows(df: DataFrame, malformed: str) -> DataFrame:
    """How many lines were read, and how many had too few or too many fields."""
    # Spark refuses a query of the malformed text alone, so the lines are counted through the first field.
    first = F.col(df.columns[0])
    return df.agg(
        (F.count(first) + F.count_if(first.isNull())).alias("n_rows"), F.count(malformed).alias("n_malformed")
    )


def malformed_lines(df: DataFrame, malformed: str, sep: str = "\t") -> DataFrame:
    """``[n_fields, n_lines, example]``: malformed lines by how many fields they have, with the smallest such line.

    Counts the separators, quoted ones included.
    """
    line = F.col(malformed)
    # Spark refuses a query of the malformed text alone; a field is never longer than its line.
    length = F.greatest(F.length(line), F.length(F.col(df.columns[0])))
    n_fields = length - F.length(F.replace(line, F.lit(sep), F.lit(""))) + 1
    return df.filter(line.isNotNull()).groupBy(n_fields.alias("n_fields")).agg(F.count("*").alias("n_lines"), F.min(line).alias("example"))


def present_paths(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """The paths, wildcards allowed, that have something in them, and those that have nothing.

    A day that was never delivered would otherwise fail the whole scan. Asks the file system once per path, so for days and not for files.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found, missing = [], []
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        (found if where.getFileSystem(conf).globStatus(where) else missing).append(path)
    return found, missing


def day_paths(base: str, first: date | str, last: date | str, below: str = "*/") -> list[str]:
    """One path per day of ``base/yyyy/MM/dd/<hour>/``, both ends included."""
    start, end = as_day(first), as_day(last)
    days = (start + timedelta(days=n) for n in range((end - start).days + 1))
    return [f"{base.rstrip('/')}/{day:%Y/%m/%d}/{below}" for day in days]
