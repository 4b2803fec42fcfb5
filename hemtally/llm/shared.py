"""What several operators need: intermediate tables in the shared folder, document keys, packed batches of texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`; where that is unset, one below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_llm_work"


#: Whether the files of a query's shuffles are removed when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read again: cuts the lineage and survives lost executors.

    Nothing reads the shuffles behind a written table again, so their files are removed at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(text))


def chunks(frames: Iterable[pd.DataFrame], text: str, size: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Cuts batches into runs of rows with about `size` characters; a longer text stands alone."""
    for frame in frames:
        if frame.empty:
            continue
        ends = frame[text].str.len().fillna(0).cumsum().to_numpy()
        part = (ends // size).astype("int64")
        for _, rows in frame.groupby(part, sort=False):
            yield rows.reset_index(drop=True)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of `edges`; the label is the smallest node of its component.

    Alternating large-star and small-star steps; every round is a written table. A node with many neighbours
    costs a minimum that is combined before the shuffle and an equi-join whose hot side adaptive execution splits.
    """

    def step(links: DataFrame, large: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
        # links hold a > b; the large star moves larger neighbours, the small star smaller ones, to the minimum
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        if large:
            moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b"))
            )
        return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    for _ in range(max_rounds):
        links = stored(step(step(links, True), False), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
