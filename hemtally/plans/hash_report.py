"""A client's hash file against the pair table: statistics, and a file of match flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hemtally.operators.hashes import LOOKUP_COLUMNS, classify_hashes, convert_hashes
from hemtally.operators.matching import domain_breakdown, match_counts, match_flags, matched_stats, pair_stats
from hemtally.sinks.delimited import write_delimited
from hemtally.sources.delimited import read_delimited
from hemtally.sources.shared import WrittenOnce
from hemtally.sources.snapshots import latest_partition, latest_value


def client_hashes(spark: SparkSession, path: str, column: str = "hem") -> DataFrame:
    """A client's one-column file; the path may have wildcards."""
    return read_delimited(spark, path, [column], sep=",")


def converted_hashes(spark: SparkSession, path: str, kind: str, lookup: DataFrame, out: str) -> DataFrame:
    """A sha1 or sha2 file turned into an md5 file at ``out``; returns that file's rows."""
    client = client_hashes(spark, path, LOOKUP_COLUMNS.get(kind, kind))
    write_delimited(convert_hashes(client, lookup, kind), out)
    return client_hashes(spark, out)


class StatReport(dict[str, DataFrame]):
    """Results by name, and what removes the table that they share."""

    drop: Callable[[], None]


def stat_report(
    original: DataFrame,
    pairs: DataFrame,
    names: DataFrame,
    converted: DataFrame | None = None,
    snapshot: str | None = None,
    n: int = 50,
) -> StatReport:
    """The parts of the statistics report. With a converted file the matches are those of its hashes.

    The pair table is counted once: the counts of the client's hashes are written to the shared folder, and both match
    reports read them. ``drop()`` of the report removes them when it is done with.
    """
    client = original if converted is None else converted
    kept = WrittenOnce(matched_stats(pair_stats(pairs, snapshot), client), "matched-stats")
    stats = kept.rows
    report = StatReport({"hash_types": classify_hashes(original)})
    report.drop = kept.drop
    if converted is not None:
        report["hash_types_converted"] = classify_hashes(converted)
    report["match_counts"] = match_counts(stats, client)
    report["domain_breakdown"] = domain_breakdown(stats, client, names, n)
    return report


def catalog_pair_stats(spark: SparkSession, table: str) -> DataFrame:
    """Pair counts of the newest snapshot of a catalog table, which the catalog names: the plan has it as a literal and opens that partition alone."""
    return pair_stats(spark.table(table), latest_partition(spark, table))


def write_match_file(
    client: DataFrame,
    graph: DataFrame,
    pairs: DataFrame,
    folder: str,
    graph_snapshot: str | None = None,
    pair_snapshot: str | None = None,
) -> str:
    """Match flags as CSV, in a folder named after both snapshots; refuses to overwrite. Returns the path.

    Snapshots that the caller knows (``latest_partition`` of a catalog table) are not looked for in the data.
    """
    graph_snapshot, pair_snapshot = graph_snapshot or latest_value(graph), pair_snapshot or latest_value(pairs)
    path = f"{folder.rstrip('/')}/L{graph_snapshot}M{pair_snapshot}"
    flags = match_flags(client, graph, pairs, graph_snapshot, pair_snapshot)
    write_delimited(flags, path, mode="errorifexists")
    return path
