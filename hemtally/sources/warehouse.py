"""Query results as DataFrames: from the session's catalog, or from a database through JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def query_rows(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)


def jdbc_rows(
    spark: SparkSession,
    url: str,
    query: str,
    *,
    split_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    readers: int | None = None,
    **options: str,
) -> DataFrame:
    """A database query, read by one task, or by ``readers`` tasks over ranges of a numeric or date column."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if split_column is None:
        return reader.option("query", query).load()
    return (
        reader.option("dbtable", f"({query}) q")
        .option("partitionColumn", split_column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", readers)
        .load()
    )
