"""How a client's hashes match a table of (hash, domain) pairs and the identity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemtally.functions.hashes import MAID_DOMAINS, is_linked_id, is_maid_domain
from hemtally.sources.snapshots import at_snapshot


def pair_stats(pairs: DataFrame, snapshot: str | None = None, region: str = "US") -> DataFrame:
    """``[hem, domain, pairs, us_pairs]``: pair rows per hash and domain, all of them and those of one region."""
    return (
        at_snapshot(pairs, snapshot)
        .groupBy("hem", "domain")
        .agg(F.count("*").alias("pairs"), F.count_if(F.col("region") == region).alias("us_pairs"))
    )


def matched_stats(stats: DataFrame, client: DataFrame) -> DataFrame:
    """Pair counts of the client's hashes only, for reports that share them.

    The semi join sits on top of the pair counts. For a short client list Catalyst moves it below them, onto the scan;
    for a long one it stays, and each hash arrives with one row per domain however many pairs it has.
    """
    return stats.join(client.select("hem").distinct(), "hem", "left_semi")


def match_counts(stats: DataFrame, client: DataFrame) -> DataFrame:
    """One row: distinct client hashes found in the pairs, and those found in the region.

    After a shuffle join, grouping by hash needs no further shuffle.
    """
    return (
        matched_stats(stats, client)
        .groupBy("hem")
        .agg(F.max("us_pairs").alias("us_pairs"))
        .agg(F.count("*").alias("matched"), F.count_if(F.col("us_pairs") > 0).alias("matched_us"))
    )


def domain_breakdown(
    stats: DataFrame, client: DataFrame, names: DataFrame, n: int = 50, dedupe_client: bool = False
) -> DataFrame:
    """The ``n`` domains with most pairs: ``[domain, name, matched_us, pairs_us]``, ties by domain.

    ``stats`` has one row per hash and domain, as ``pair_stats`` gives. A hash that the client lists twice counts its
    pairs twice, unless ``dedupe_client``; the copies are counted first and multiplied in, never joined row by row.
    Names are looked up after the domains are summed up; a domain without one stays, a domain with two has two rows.
    """
    listed = client.groupBy("hem").agg(F.count("*").alias("copies"))
    # The condition on copies makes the semi join read the same rows as the join after it, so that Spark computes and
    # sends the client list once.
    in_list = (stats["hem"] == listed["hem"]) & (listed["copies"] > 0)
    matched = stats.join(listed, in_list, "left_semi")
    weight = F.lit(1)
    if not dedupe_client:
        matched = matched.join(listed, "hem")
        weight = F.col("copies")
    domains = matched.groupBy(F.col("domain").cast("string").alias("domain")).agg(
        F.count_if(F.col("us_pairs") > 0).alias("matched_us"), F.sum(F.col("us_pairs") * weight).alias("pairs_us")
    )
    labels = names.groupBy(F.col("id").cast("string").alias("domain"), "name").agg(F.count("*").alias("rows"))
    return (
        domains.join(labels, "domain", "left")
        .select(
            "domain",
            "name",
            "matched_us",
            (F.col("pairs_us") * F.coalesce("rows", F.lit(1))).alias("pairs_us"),
        )
        .orderBy(F.desc("pairs_us"), "domain", "name")
        .limit(n)
    )


def match_flags(
    client: DataFrame,
    graph: DataFrame,
    pairs: DataFrame,
    graph_snapshot: str | None = None,
    pair_snapshot: str | None = None,
    maid_domains: tuple[str, ...] = MAID_DOMAINS,
) -> DataFrame:
    """``[hem, has_linked, has_maid]`` for each distinct client hash; NULL stays, with both flags false.

    All three key lists are distinct before they are joined, so no row is multiplied and all share one partitioning
    by hash. The semi joins look redundant but carry a short client list down to the scans of the large tables,
    whose other keys are then dropped before any shuffle.
    """
    wanted = client.select("hem").distinct()
    linked = at_snapshot(graph, graph_snapshot).filter(is_linked_id(F.col("identifier"))).select(F.col("hash").alias("hem"))
    mobile = at_snapshot(pairs, pair_snapshot).filter(is_maid_domain(F.col("domain"), maid_domains)).select("hem")

    def found(keys: DataFrame, flag: str) -> DataFrame:
        return keys.distinct().join(wanted, "hem", "left_semi").withColumn(flag, F.lit(True))

    return (
        wanted.join(found(linked, "has_linked"), "hem", "left")
        .join(found(mobile, "has_maid"), "hem", "left")
        .select("hem", F.col("has_linked").isNotNull().alias("has_linked"), F.col("has_maid").isNotNull().alias("has_maid"))
    )
