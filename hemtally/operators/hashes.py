"""Hashed emails in a client's file: what kind they are, and turning sha1 or sha2 into md5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemtally.functions.hashes import hash_type
from hemtally.operators.keys import key_list
from hemtally.sources.snapshots import at_snapshot

# The lookup table's column for each kind that can be converted.
LOOKUP_COLUMNS = {"sha1": "sh1", "sha2": "sh2"}


def classify_hashes(df: DataFrame, column: str = "hem") -> DataFrame:
    """Values and distinct values per kind of hash, as ``[h_type, n, n_distinct]``. NULLs are invalid and count 0.

    A value has one kind, so counting per value first and then per kind is exact, and copies of a frequent value are
    combined before the shuffle.
    """
    return (
        df.groupBy(F.col(column).alias("hem"))
        .agg(F.count(column).alias("n"))
        .groupBy(hash_type(F.col("hem")).alias("h_type"))
        .agg(F.sum("n").alias("n"), F.count("hem").alias("n_distinct"))
    )


def convert_hashes(client: DataFrame, lookup: DataFrame, kind: str, snapshot: str | None = None) -> DataFrame:
    """Distinct md5 of the client's sha1 or sha2 hashes, through one snapshot of a lookup table.

    ``client`` has the column ``sh1`` or ``sh2``. A semi join, as nothing but its keys is needed: a short client list
    is sent to the lookup table's tasks (Spark checks its size) and only matches are shuffled.
    """
    if kind not in LOOKUP_COLUMNS:
        raise ValueError(f"kind must be one of {', '.join(LOOKUP_COLUMNS)}, not {kind}")
    key = LOOKUP_COLUMNS[kind]
    wanted = key_list(client, key)
    return at_snapshot(lookup, snapshot).join(wanted, key, "left_semi").select("md5").distinct()
