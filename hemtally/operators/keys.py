"""Key lists for semi joins, and what follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Into how many groups the copies of a listed key may fall.
COPIES = 16


def key_list(df: DataFrame, key: str) -> DataFrame:
    """The values of ``key``, each at most ``COPIES`` times, to filter rows of which very many may share a key.

    Not quite distinct, on purpose. Copies are combined before any shuffle, but the result is not partitioned by the
    key, so a shuffle join has to exchange it, and only between two exchanges can AQE split an oversized partition of
    the other side. A semi join does not mind the copies. For rows that are already unique by key, a distinct list
    saves that exchange.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(COPIES)).alias("part")
    return df.select(key, part).distinct().select(key)


def apart(df: DataFrame, key: str) -> DataFrame:
    """The same rows, with ``key`` as text of which Spark doesn't know that they are partitioned by it.

    To stand between a join by ``key`` and an aggregation by more keys. Otherwise the join's partitioning serves the aggregation too, in one stage, and
    AQE cannot split a join whose partitions something above it relies on. So the aggregation combines rows in each of the join's (split)
    tasks and exchanges them by all of its keys.
    """
    return df.withColumn(key, F.concat(F.col(key), F.lit("")))
