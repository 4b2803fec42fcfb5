"""Where jobs put tables that another step reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path in ``folder``, else in ``spark.checkpoint.dir``, else below the warehouse; the same rule on every master."""
    base = folder or spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_between_steps"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes a folder that a plan is done with, in whatever file system it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settled(df: DataFrame, *paths: str) -> DataFrame:
    """The rows as a checkpoint, after which the given paths are removed: for a result that was read from files of its own."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_path(spark, "checkpoints"))
    kept = df.checkpoint()
    for path in paths:
        remove_path(spark, path)
    return kept


class WrittenOnce:
    """A result in the shared folder that several jobs read: lost executors cost no rerun. Leaving the block removes it."""

    def __init__(self, df: DataFrame, name: str, folder: str | None = None) -> None:
        self.spark = df.sparkSession
        self.path = shared_path(self.spark, name, folder)
        df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def __enter__(self) -> DataFrame:
        return self.rows

    def __exit__(self, *_: object) -> None:
        self.drop()

    def drop(self) -> None:
        remove_path(self.spark, self.path)
