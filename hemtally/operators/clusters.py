"""Identity clusters: one row per cluster with a ``|``-separated list of ``domain:id`` tokens."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemtally.functions.hashes import MAID_DOMAINS, is_maid_domain
from hemtally.functions.tokens import has_token_prefix, token_domain

# The percentiles of the report, those of its older form, and the labels of the total rows.
PERCENTILES = (0.0, 0.25, 0.5, 0.75, 0.85, 0.90, 0.95, 1.0)
FIVE_POINTS = (0.0, 0.25, 0.5, 0.75, 1.0)
ALL_LABEL = "ALL"
MAID_LABEL = "MAID ALL"

# What a distribution row stands for; kept apart from the label, which a domain could spell the same.
_ALL, _DOMAIN, _MAID = 0, 1, 2


def check_cluster_file(df: DataFrame, token_col: str) -> DataFrame:
    """One row: rows read, rows whose token list does not start like one, and whether the file is usable."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(~has_token_prefix(F.col(token_col))).alias("n_invalid")
    ).withColumn("is_valid", (F.col("n_rows") > 0) & (F.col("n_invalid") == 0))


def check_column_count(df: DataFrame, expected: int = 2) -> None:
    """The older check: a cluster file has exactly this many columns."""
    if len(df.columns) != expected:
        raise ValueError(f"expected {expected} columns, the file has {len(df.columns)}")


def explode_clusters(df: DataFrame, id_col: str, token_col: str) -> DataFrame:
    """Long form ``[cluster_id, pid, domain]``, one row per token. A NULL list has no tokens."""
    return df.select(
        F.col(id_col).alias("cluster_id"), F.explode(F.split(F.col(token_col), r"\|")).alias("pid")
    ).withColumn("domain", token_domain(F.col("pid")))


def pids_per_cluster(
    long: DataFrame,
    percentiles: Sequence[float] = PERCENTILES,
    accuracy: int | None = None,
    maid_domains: tuple[str, ...] = MAID_DOMAINS,
    digits: int | None = None,
) -> DataFrame:
    """Distribution of tokens per cluster: for all domains, for each domain, and for the mobile ones together.

    ``[domain, ct, mean, min, p25, ..., max]``. ``ct`` is the number of clusters; the sizes are per cluster *and*
    domain. The mobile total appears only if every mobile domain does. Percentiles are sizes that occur (the
    discrete kind); with ``accuracy`` they come from Spark's sketch, whose rank is off by at most 1/accuracy.

    With ``digits`` they come from summaries that count sizes by their first ``digits`` binary digits: the same however rows lie in tasks, and they add up
    over files. A percentile is then the largest size of the one bin that holds the exact percentile, so less than 1 / 2 ** (digits - 1) above it, and the
    column ``rank_error`` certifies its rank: at most that share of the groups lies between it and the exact one, for any of the percentiles.
    """
    return _distribution(long, ("cluster",), percentiles, accuracy, maid_domains, digits).drop("kind", "scope")


def clusters_per_pid(
    long: DataFrame,
    percentiles: Sequence[float] = PERCENTILES,
    accuracy: int | None = None,
    maid_domains: tuple[str, ...] = MAID_DOMAINS,
    digits: int | None = None,
) -> DataFrame:
    """The same for the tokens: how often each id occurs. ``ct`` is the number of ids."""
    return _distribution(long, ("pid",), percentiles, accuracy, maid_domains, digits).drop("kind", "scope")


def cluster_report(
    long: DataFrame,
    percentiles: Sequence[float] = PERCENTILES,
    accuracy: int | None = None,
    maid_domains: tuple[str, ...] = MAID_DOMAINS,
) -> DataFrame:
    """Both distributions side by side, one row per domain, columns prefixed ``cluster_`` and ``pid_``.

    Both come out of one pass over the long form, so the file is read and exploded once.
    """
    both = _distribution(long, ("cluster", "pid"), percentiles, accuracy, maid_domains)
    measures = [c for c in both.columns if c not in ("kind", "scope", "domain")]
    return (
        both.groupBy("scope", "domain")
        .agg(
            *(
                F.max(F.when(F.col("kind") == kind, F.col(measure))).alias(f"{kind}_{measure}")
                for kind in ("cluster", "pid")
                for measure in measures
            )
        )
        .drop("scope")
    )


def _distribution(
    long: DataFrame,
    kinds: tuple[str, ...],
    percentiles: Sequence[float],
    accuracy: int | None,
    maid_domains: tuple[str, ...],
    digits: int | None = None,
) -> DataFrame:
    """``[kind, scope, domain, ct, mean, <percentiles>]`` of group sizes, groups being (key, domain) for each kind.

    Only the first aggregation sees every token, and it combines copies before the shuffle. Its groups are then
    counted by size, and percentiles come from those histograms: different sizes add up to no more than the tokens, so
    N tokens have at most about sqrt(2N) of them and a histogram stays small however large the file is.
    """
    keys = {"cluster": F.col("cluster_id").cast("string"), "pid": F.col("pid")}
    # An exploded array and not an unpivot: Spark does not see that two unpivots are the same, and the sketches, which
    # need the sizes as well, would read the file again.
    group = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), keys[kind].alias("key")) for kind in kinds)))
    sizes = (
        long.select("domain", group.alias("group"))
        .groupBy(F.col("group.kind").alias("kind"), "domain", F.col("group.key").alias("key"))
        .agg(F.count("*").alias("ct"))
    )
    if digits is not None:
        measured = _measures(sizes, percentiles, maid_domains, digits)
    elif accuracy is None:
        measured = _measures(sizes, percentiles, maid_domains)
    else:
        sketches = _sketched_percentiles(sizes, percentiles, accuracy, maid_domains)
        measured = _measures(sizes, (), maid_domains).join(sketches, ["kind", "total"])
    every_maid = F.forall(F.array(*_seen_columns(maid_domains)), lambda seen: seen)
    # A token has one domain, so each (token, domain) group is a token of its own; clusters have to be told apart.
    whole_clusters = (F.col("kind") == "cluster") & (F.col("total.scope") != _DOMAIN)
    return measured.filter((F.col("total.scope") != _MAID) | every_maid).select(
        "kind",
        "total.scope",
        "total.domain",
        F.when(whole_clusters, F.col("n_clusters")).otherwise(F.col("n_groups")).alias("ct"),
        "mean",
        *map(_percentile_name, percentiles),
        *([] if digits is None else ["rank_error"]),
    )


def _measures(
    sizes: DataFrame, percentiles: Sequence[float], maid_domains: tuple[str, ...], digits: int | None = None
) -> DataFrame:
    """Counts, mean and percentiles per kind and result row: exact, or from bins of sizes that share their first digits.

    One pass counts two things: groups by (domain, size), few rows, and clusters, one row each with whether it has a
    mobile id. Ids need no such count, so all of them fall into one row. The rows of clusters have no size.
    """
    cluster = F.when(F.col("kind") == "cluster", F.col("key"))
    if digits is not None:
        return _binned_measures(sizes.withColumn("cluster", cluster), percentiles, maid_domains, digits)
    counted = (
        sizes.select("kind", "ct", F.col("domain").alias("source"), cluster.alias("cluster"))
        .groupingSets(
            [["kind", "source", "ct"], ["kind", "cluster"]], "kind", "source", "ct", "cluster"
        )
        .agg(F.count("*").alias("n"), F.max(is_maid_domain(F.col("source"), maid_domains)).alias("maid"))
    )
    is_size = F.col("ct").isNotNull()
    histograms = (
        counted.select(
            "kind",
            "ct",
            F.when(is_size, F.col("n")).alias("n"),
            "cluster",
            "source",
            _totals(F.col("source"), F.col("maid")),
        )
        .groupBy("kind", "total", "ct")
        .agg(
            F.sum("n").alias("n"),
            F.count("cluster").alias("n_clusters"),
            *(F.max(F.col("source") == name).alias(seen) for name, seen in zip(maid_domains, _seen_columns(maid_domains))),
        )
    )
    group = Window.partitionBy("kind", "total")
    rank = F.sum("n").over(group.orderBy("ct").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = histograms.withColumn("rank", rank).withColumn("of", F.sum("n").over(group))

    def percentile(p: float) -> Column:
        # Decimals: 0.9 of 10 groups has to be the 9th, not the one after it.
        reached = F.col("rank") >= F.lit(Decimal(str(p))) * F.col("of").cast("decimal(20,0)")
        return F.min(F.when(reached, F.col("ct"))).alias(_percentile_name(p))

    return ranked.groupBy("kind", "total").agg(
        F.sum("n").alias("n_groups"),
        F.sum("n_clusters").alias("n_clusters"),
        F.round(F.sum(F.col("ct") * F.col("n")) / F.sum("n"), 1).alias("mean"),
        *map(percentile, percentiles),
        *(F.max(seen).alias(seen) for seen in _seen_columns(maid_domains)),
    )


def _binned_measures(
    sizes: DataFrame, percentiles: Sequence[float], maid_domains: tuple[str, ...], digits: int
) -> DataFrame:
    """``_measures`` by bins. A result row has at most 2 ** digits * 64 bins, so they fit into one array and need no ordering by shuffle."""
    ct = F.col("ct")
    width = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(ct)) - digits)).cast("long")
    counted = (
        sizes.select("kind", "ct", (ct - ct % width).alias("bin"), F.col("domain").alias("source"), "cluster")
        .groupingSets([["kind", "source", "bin"], ["kind", "cluster"]], "kind", "source", "bin", "cluster")
        .agg(
            F.count("*").alias("n"), F.sum("ct").alias("tokens"), F.min("ct").alias("low"), F.max("ct").alias("top"),
            F.max(is_maid_domain(F.col("source"), maid_domains)).alias("maid"),
        )
    )
    total = _totals(F.col("source"), F.col("maid"))
    binned = F.col("bin").isNotNull()
    bins = (
        counted.select("kind", "bin", "cluster", "source", total, "low", "top", *(F.when(binned, F.col(c)).alias(c) for c in ("n", "tokens")))
        .groupBy("kind", "total", "bin")
        .agg(
            F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.min("low").alias("low"), F.max("top").alias("top"),
            F.count("cluster").alias("n_clusters"),
            *(F.max(F.col("source") == name).alias(seen) for name, seen in zip(maid_domains, _seen_columns(maid_domains))),
        )
    )
    kept = F.when(F.col("bin").isNotNull(), F.struct("bin", "n", "low", "top"))
    measured = bins.groupBy("kind", "total").agg(
        F.sum("n").alias("n_groups"),
        F.sum("n_clusters").alias("n_clusters"),
        F.round(F.sum("tokens") / F.sum("n"), 1).alias("mean"),
        F.array_sort(F.collect_list(kept)).alias("bins"),
        *(F.max(seen).alias(seen) for seen in _seen_columns(maid_domains)),
    )

    def found(p: float) -> Column:
        target = F.lit(Decimal(str(p))) * F.col("n_groups").cast("decimal(20,0)")

        def step(state: Column, b: Column) -> Column:
            here = state["top"].isNull() & (state["rank"] + b["n"] >= target)
            return F.struct(
                (state["rank"] + b["n"]).alias("rank"),
                F.when(here, b["top"]).otherwise(state["top"]).alias("top"),
                F.when(here & (b["low"] < b["top"]), b["n"]).otherwise(state["unsure"]).alias("unsure"),
            )

        nothing = F.lit(None).cast("long")
        return F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("rank"), nothing.alias("top"), F.lit(0).cast("long").alias("unsure")), step)

    measured = measured.withColumns({f"at_{n}": found(p) for n, p in enumerate(percentiles)})
    unsure = F.array_max(F.array(*(F.col(f"at_{n}.unsure") for n in range(len(percentiles)))))
    return measured.withColumns(
        {_percentile_name(p): F.col(f"at_{n}.top") for n, p in enumerate(percentiles)} | {"rank_error": F.round(unsure / F.col("n_groups"), 6)}
    ).drop("bins")


def _sketched_percentiles(
    sizes: DataFrame, percentiles: Sequence[float], accuracy: int, maid_domains: tuple[str, ...]
) -> DataFrame:
    domain = F.col("domain")
    sketches = (
        sizes.select("kind", "ct", _totals(domain, is_maid_domain(domain, maid_domains)))
        .groupBy("kind", "total")
        .agg(F.percentile_approx("ct", list(percentiles), accuracy).alias("ntile"))
    )
    return sketches.select(
        "kind", "total", *(F.col("ntile")[n].alias(_percentile_name(p)) for n, p in enumerate(percentiles))
    )


def _totals(domain: Column, maid: Column) -> Column:
    """One ``total`` per result row that a row counts for; a row without a domain counts for the sums only."""
    rows = F.array(
        F.struct(F.lit(_ALL).alias("scope"), F.lit(ALL_LABEL).alias("domain")),
        F.when(domain.isNotNull(), F.struct(F.lit(_DOMAIN).alias("scope"), domain.alias("domain"))),
        F.when(maid, F.struct(F.lit(_MAID).alias("scope"), F.lit(MAID_LABEL).alias("domain"))),
    )
    return F.explode(F.array_compact(rows)).alias("total")


def _seen_columns(maid_domains: tuple[str, ...]) -> list[str]:
    return [f"seen_{n}" for n in range(len(maid_domains))]


def _percentile_name(p: float) -> str:
    names = {0: "min", 1: "max"}
    return names.get(p) or f"p{p * 100:g}".replace(".", "_")
