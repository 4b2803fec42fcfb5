"""Reports on a delivered file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from hemtally.operators.clusters import check_cluster_file, cluster_report, explode_clusters
from hemtally.operators.profile import preview, profile_file
from hemtally.sources.delimited import malformed_rows, read_delimited


def file_report(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "\t") -> dict[str, DataFrame]:
    """Any delimited file: example rows, counts per column, and lines with a wrong number of fields."""
    file = read_delimited(spark, path, columns, sep)
    checked = read_delimited(spark, path, columns, sep, malformed="_malformed")
    return {
        "preview": preview(file),
        "profile": profile_file(file),
        "malformed": malformed_rows(checked, "_malformed"),
    }


def cluster_file_report(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "\t") -> dict[str, DataFrame]:
    """A cluster file, ids in the first column and token lists in the last: its check and its distributions."""
    file = read_delimited(spark, path, columns, sep)
    return {
        "check": check_cluster_file(file, columns[-1]),
        "distribution": cluster_report(explode_clusters(file, columns[0], columns[-1])),
    }
