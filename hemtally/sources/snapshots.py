"""Tables that hold one full snapshot per value of a date string column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_snapshot(df: DataFrame, column: str = "date_p") -> DataFrame:
    """Rows of the newest snapshot.

    The newest value is a scalar subquery: nothing runs until the result is used, and on a table partitioned by
    ``column`` only that partition's files are read. The subquery itself reads no data columns.
    """
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())


def at_snapshot(df: DataFrame, snapshot: str | None = None, column: str = "date_p") -> DataFrame:
    """Rows of a given snapshot (a literal, pruned while planning), or of the newest one."""
    if snapshot is None:
        return latest_snapshot(df, column)
    return df.filter(F.col(column) == F.lit(snapshot))


def latest_value(df: DataFrame, column: str = "date_p") -> str:
    """The newest snapshot's name, for jobs that put it into a path. Runs a job that returns one value; a table without any is an error."""
    value = df.agg(F.max(column)).first()[0]
    if value is None:
        raise ValueError(f"the table has no snapshot: {column} has no value")
    return value


def latest_partition(spark: SparkSession, table: str, column: str = "date_p") -> str | None:
    """The newest snapshot of a partitioned catalog table, from the catalog instead of from the files.

    ``max`` over a partition column still opens every file of the table for its row count; here the catalog lists
    the partitions and only the newest is probed for a row. Registered but empty partitions are passed over, as
    ``max`` would.
    """
    rows = spark.table(table)
    newest_first = (
        spark.sql(f"SHOW PARTITIONS {table}")
        .select(F.str_to_map("partition", F.lit("/"), F.lit("="))[column].alias(column))
        .distinct()
        .orderBy(F.desc(column))
    )
    for (value,) in newest_first.toLocalIterator():
        if not rows.filter(F.col(column) == F.lit(value)).isEmpty():
            return value
    return None
