
from __future__ import annotations

import sys
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hemtally import operators as ops  # noqa: E402
from hemtally import plans  # noqa: E402
from hemtally.functions import days_before  # noqa: E402
from hemtally.operators.audience import CATEGORY, USER_AGENT, WINDOWS_WITH_180, flat_impressions  # noqa: E402
from hemtally.operators.clusters import FIVE_POINTS  # noqa: E402
from hemtally.sample import ACTIVITY_RUN, IMPRESSION_RUN, Sample  # noqa: E402
from hemtally.sinks import DayTable, load_snapshot, write_delimited  # noqa: E402
from hemtally.sources import malformed_lines, read_delimited, settled, shared_path  # noqa: E402

ADVERTISER = "101"
WINDOW = ("2024-01-05", "2024-01-20")
SKIPPED = ("2001-07-15",)


try:  # the training-data operators can be taken out as a whole
    import corpus_pipeline
    from hemtally.llm import queries as llm
except ImportError as error:
    llm = None
    if (Path(__file__).resolve().parent / "hemtally" / "llm" / "queries.py").exists():
        warnings.warn(f"the training-data queries are left out: {error}", stacklevel=1)


def entry(spark: SparkSession) -> DataFrame:
    """The domain breakdown of a client's hashes."""
    return _domain_breakdown(spark, "/root/testdata/sf0.001")


def _file_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.profile_file(Sample(spark, sf_dir).file())


def _cluster_file_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.check_cluster_file(Sample(spark, sf_dir).clusters(), "tokens")


def _long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.explode_clusters(Sample(spark, sf_dir).clusters(), "cluster_id", "tokens")


def _pids_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pids_per_cluster(_long_form(spark, sf_dir))


def _pids_per_cluster_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pids_per_cluster(_long_form(spark, sf_dir), accuracy=100)


def _pids_per_cluster_five_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pids_per_cluster(_long_form(spark, sf_dir), FIVE_POINTS)


def _clusters_per_pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.clusters_per_pid(_long_form(spark, sf_dir))


def _cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cluster_report(_long_form(spark, sf_dir))


def _hash_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.classify_hashes(Sample(spark, sf_dir).client_mixed())


def _hash_types_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "client")
    write_delimited(Sample(spark, sf_dir).client_mixed(), path)
    return settled(ops.classify_hashes(plans.client_hashes(spark, f"{path}/part-*")), path)


def _hash_types_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.classify_hashes(_hash_conversion_sha1(spark, sf_dir), "md5")


def _hash_conversion_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = Sample(spark, sf_dir)
    return ops.convert_hashes(sample.client_sha1(), sample.hash_lookup(), "sha1")


def _hash_conversion_sha2(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = Sample(spark, sf_dir)
    return ops.convert_hashes(sample.client_sha2(), sample.hash_lookup(), "sha2")


def _pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pair_stats(Sample(spark, sf_dir).pairs())


def _pair_stats_fixed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pair_stats(Sample(spark, sf_dir).pairs(), snapshot="20001231")


def _match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = Sample(spark, sf_dir)
    return ops.match_counts(ops.pair_stats(sample.pairs()), sample.client_md5())


def _domain_breakdown(spark: SparkSession, sf_dir: str, dedupe_client: bool = False) -> DataFrame:
    sample = Sample(spark, sf_dir)
    stats = ops.pair_stats(sample.pairs())
    return ops.domain_breakdown(stats, sample.client_md5(), sample.domain_names(), dedupe_client=dedupe_client)


def _domain_breakdown_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _domain_breakdown(spark, sf_dir, dedupe_client=True)


def _match_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = Sample(spark, sf_dir)
    return ops.match_flags(sample.client_md5(), sample.graph(), sample.pairs())


def _cookies_to_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = Sample(spark, sf_dir)
    return ops.cookies_to_hashes(sample.weblog(), sample.graph(), ADVERTISER)


def _cookies_to_hashes_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = Sample(spark, sf_dir)
    return ops.cookies_to_hashes(sample.weblog(), sample.graph(), ADVERTISER, *WINDOW)


def _audience_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = Sample(spark, sf_dir)
    return ops.audience_impressions(sample.impressions(), sample.emails(), IMPRESSION_RUN, skip_dates=SKIPPED)


def _hash_match_counts(
    spark: SparkSession, sf_dir: str, windows: tuple[int, ...] = ops.audience.WINDOWS
) -> DataFrame:
    sample = Sample(spark, sf_dir)
    rows = ops.lookback(sample.impressions(), IMPRESSION_RUN, skip_dates=SKIPPED)
    return ops.hash_match_counts(rows, ops.audience_members(sample.emails()), windows)


def _hash_match_counts_180(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hash_match_counts(spark, sf_dir, WINDOWS_WITH_180)


def _from_daily_counts(
    spark: SparkSession, sf_dir: str, keys: tuple[str, ...], max_days: int, count: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Two runs, the later one adding the days since the earlier one; counted for the later one."""
    sample = Sample(spark, sf_dir)
    impressions, members = flat_impressions(sample.impressions()), ops.audience_members(sample.emails())
    store = shared_path(spark, "daily-counts")
    (week_before,) = days_before(IMPRESSION_RUN, 7, 7)
    for run in (week_before, IMPRESSION_RUN):
        plans.refresh_daily_counts(impressions, members, store, run, keys, max_days, SKIPPED)
    return settled(count(plans.read_daily_counts(impressions, store, IMPRESSION_RUN, keys, max_days, SKIPPED)), store)


def _hash_match_counts_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_daily_counts(spark, sf_dir, ("md5",), ops.audience.MAX_DAYS, ops.hash_match_counts)


def _hash_match_counts_redone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored day computed again after its impressions turned out to be of nobody on the list."""
    sample = Sample(spark, sf_dir)
    members, store, keys = ops.audience_members(sample.emails()), shared_path(spark, "daily-counts"), ("md5",)
    (day,) = days_before(IMPRESSION_RUN, 1, 1)
    before = flat_impressions(sample.impressions())
    nobody = F.when(F.col("date_p") == F.lit(day), F.concat("md5", F.lit("x"))).otherwise(F.col("md5"))
    after = before.withColumn("md5", nobody)
    plans.refresh_daily_counts(before, members, store, IMPRESSION_RUN, keys, skip_dates=SKIPPED)
    plans.refresh_daily_counts(after, members, store, IMPRESSION_RUN, keys, skip_dates=SKIPPED, redo=[day])
    return settled(ops.hash_match_counts(plans.read_daily_counts(after, store, IMPRESSION_RUN, keys, skip_dates=SKIPPED)), store)


def _user_agent_counts_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_daily_counts(spark, sf_dir, USER_AGENT, ops.audience.DETAIL_DAYS, ops.user_agent_counts)


def _category_counts_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_daily_counts(spark, sf_dir, CATEGORY, ops.audience.DETAIL_DAYS, ops.category_counts)


def _user_agent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = Sample(spark, sf_dir)
    rows = flat_impressions(ops.lookback(sample.impressions(), IMPRESSION_RUN, skip_dates=SKIPPED))
    return ops.user_agent_counts(rows, ops.audience_members(sample.emails()))


def _category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = Sample(spark, sf_dir)
    rows = ops.lookback(sample.impressions(), IMPRESSION_RUN, skip_dates=SKIPPED)
    return ops.category_counts(rows, ops.audience_members(sample.emails()))


def _date_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.date_coverage(Sample(spark, sf_dir).impressions(), IMPRESSION_RUN)


def _snapshot_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target loaded with its own dates, then one day of it replaced, twice."""
    sample = Sample(spark, sf_dir)
    target = shared_path(spark, "snapshots")
    load_snapshot(sample.load_target(), target, ACTIVITY_RUN)
    for _ in range(2):
        load_snapshot(sample.load_incoming(), target, ACTIVITY_RUN)
    return settled(spark.read.parquet(target), target)


def _snapshot_load_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same loads, each one commit."""
    sample = Sample(spark, sf_dir)
    target = shared_path(spark, "snapshots")
    table = DayTable(spark, target)
    table.load(sample.load_target(), ACTIVITY_RUN)
    for _ in range(2):
        table.load(sample.load_incoming(), ACTIVITY_RUN)
    table.vacuum()
    return settled(table.read(), target)


def _daily_load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dated file of a daily load, read back."""
    folder = shared_path(spark, "daily-load")
    path = plans.daily_load(Sample(spark, sf_dir).load_incoming(), "job", f"{folder}/csv", f"{folder}/table", ACTIVITY_RUN)
    return settled(spark.read.option("header", True).schema('kind string, user long, event_date date').csv(path), folder)


def _snapshot_load_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants loaded by their days: a day loaded twice, then a load of another day without rows for it."""
    events, target = Sample(spark, sf_dir).table("events"), shared_path(spark, "snapshots")
    load_snapshot(events.select(F.col("event_type").alias("kind"), F.col("user_id").alias("user"), F.col("ts").alias("event_date")), target, ACTIVITY_RUN)
    for kind, instant in (("early", "2024-01-30 05:00:00"), ("late", "2024-01-30 06:00:00"), ("other", "2024-01-29 07:00:00")):
        at = F.lit(instant).cast(events.schema["ts"].dataType)
        load_snapshot(events.select(F.lit(kind).alias("kind"), F.col("user_id").alias("user"), at.alias("event_date")), target, ACTIVITY_RUN)
    loaded = spark.read.parquet(target)
    instant = F.date_format("event_date_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("instant")
    return settled(loaded.select("kind", "user", instant, "event_date"), target)


def _match_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of match flags, read back."""
    sample = Sample(spark, sf_dir)
    folder = shared_path(spark, "match-file")
    path = plans.write_match_file(sample.client_md5(), sample.graph(), sample.pairs(), folder, "20240130", "20010801")
    return settled(spark.read.schema("hem string, has_linked boolean, has_maid boolean").csv(path), folder)


def _pids_per_cluster_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pids_per_cluster(_long_form(spark, sf_dir), digits=2)


def _clusters_per_pid_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.clusters_per_pid(_long_form(spark, sf_dir), digits=4)


def _profile_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts merged from sketches of days that were stored in two loads, held against the exact ones."""
    log, store = Sample(spark, sf_dir).weblog().drop("ts"), shared_path(spark, "profiles")
    first = F.col("log_date") <= F.lit("2024-01-15").cast("date")
    for some in (first, ~first):
        ops.profile_sketches(log.filter(some), "log_date").write.mode("append").parquet(store)
    exact = ops.profile_file(log.drop("log_date")).select("column", F.col("n_distinct").alias("exact"))
    merged = ops.merged_profile(spark.read.parquet(store)).join(exact, "column")
    certified = F.col("exact").between(F.col("n_least"), F.col("n_most"))
    return settled(merged.select("column", "n_rows", F.col("exact").alias("n_distinct"), certified.alias("certified")), store)


def _file_profile_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "file")
    write_delimited(Sample(spark, sf_dir).file(), path, sep="\t")
    return settled(plans.file_report(spark, path, ["_c0", "_c1", "_c2"])["profile"], path)


def _cluster_report_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "clusters")
    write_delimited(Sample(spark, sf_dir).clusters(), path, sep="\t")
    return settled(plans.cluster_file_report(spark, path, ["cluster_id", "tokens"])["distribution"], path)


def _malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "lines")
    Sample(spark, sf_dir).uneven_lines().write.text(path)
    read = read_delimited(spark, path, ["key", "segment", "name"], ";", malformed="line")
    return settled(malformed_lines(read, "line", ";"), path)


def _converted_domain_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of other hashes turned into an md5 file, and the report on that."""
    sample, folder = Sample(spark, sf_dir), shared_path(spark, "converted")
    write_delimited(sample.client_sha1(), f"{folder}/sha1")
    converted = plans.converted_hashes(spark, f"{folder}/sha1", "sha1", sample.hash_lookup(), f"{folder}/md5")
    report = plans.stat_report(plans.client_hashes(spark, f"{folder}/sha1"), sample.pairs(), sample.domain_names(), converted)
    result = settled(report["domain_breakdown"], folder)
    report.drop()
    return result


def _delivered_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw log days, the last ones not delivered, to the delivered file, read back."""
    sample, folder = Sample(spark, sf_dir), shared_path(spark, "delivery")
    sample.raw_log(f"{folder}/log")
    path = plans.deliver_cookie_hashes(spark, f"{folder}/log", sample.graph(), ADVERTISER, f"{folder}/out", "2024-01-20", "2024-02-03", most_missing=4)
    return settled(spark.read.schema("hem string").option("sep", "\t").csv(path), folder)


def _pair_stats_from_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "pairs")
    table = folder.rsplit("/", 1)[-1].replace("-", "_")
    Sample(spark, sf_dir).pairs().write.partitionBy("date_p").option("path", folder).saveAsTable(table)
    result = settled(plans.catalog_pair_stats(spark, table), folder)
    spark.sql(f"drop table {table}")
    return result


def _hash_match_counts_text_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days kept as text, yyyyMMdd."""
    sample = Sample(spark, sf_dir)
    text = sample.impressions().withColumn("date_p", F.date_format("date_p", "yyyyMMdd"))
    return ops.hash_match_counts(ops.lookback(text, IMPRESSION_RUN, skip_dates=SKIPPED), ops.audience_members(sample.emails()))


def _audience_run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three files of a run, read back."""
    sample, folder = Sample(spark, sf_dir), shared_path(spark, "audience-run")
    plans.audience_run(sample.impressions(), sample.emails(), folder, IMPRESSION_RUN, SKIPPED, max_files=3)
    return settled(plans.read_run(sample.impressions(), folder), folder)


def _period_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.period_activity(Sample(spark, sf_dir).activity(), ACTIVITY_RUN)


def _alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = Sample(spark, sf_dir)
    return plans.decline_alerts(sample.activity(), sample.owners(), ACTIVITY_RUN, 0.5, "Templates in decline")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator or form of it; each takes (spark, data folder)."""
    own = {
        "file_profile": _file_profile,
        "cluster_file_check": _cluster_file_check,
        "cluster_long_form": _long_form,
        "pids_per_cluster": _pids_per_cluster,
        "pids_per_cluster_approx": _pids_per_cluster_approx,
        "pids_per_cluster_five_points": _pids_per_cluster_five_points,
        "clusters_per_pid": _clusters_per_pid,
        "cluster_report": _cluster_report,
        "hash_types": _hash_types,
        "hash_types_from_file": _hash_types_from_file,
        "hash_types_converted": _hash_types_converted,
        "hash_conversion_sha1": _hash_conversion_sha1,
        "hash_conversion_sha2": _hash_conversion_sha2,
        "pair_stats": _pair_stats,
        "pair_stats_fixed_snapshot": _pair_stats_fixed_snapshot,
        "match_counts": _match_counts,
        "domain_breakdown": _domain_breakdown,
        "domain_breakdown_deduped": _domain_breakdown_deduped,
        "match_flags": _match_flags,
        "cookies_to_hashes": _cookies_to_hashes,
        "cookies_to_hashes_window": _cookies_to_hashes_window,
        "audience_impressions": _audience_impressions,
        "hash_match_counts": _hash_match_counts,
        "hash_match_counts_180": _hash_match_counts_180,
        "hash_match_counts_incremental": _hash_match_counts_incremental,
        "hash_match_counts_redone": _hash_match_counts_redone,
        "user_agent_counts": _user_agent_counts,
        "user_agent_counts_incremental": _user_agent_counts_incremental,
        "category_counts": _category_counts,
        "category_counts_incremental": _category_counts_incremental,
        "date_coverage": _date_coverage,
        "snapshot_load": _snapshot_load,
        "snapshot_load_timestamps": _snapshot_load_timestamps,
        "match_file": _match_file,
        "period_activity": _period_activity,
        "alert_rows": _alert_rows,
        "snapshot_load_atomic": _snapshot_load_atomic,
        "daily_load_csv": _daily_load_csv,
        "pids_per_cluster_certified": _pids_per_cluster_certified,
        "clusters_per_pid_certified": _clusters_per_pid_certified,
        "profile_of_days": _profile_of_days,
        "file_profile_from_file": _file_profile_from_file,
        "cluster_report_from_file": _cluster_report_from_file,
        "malformed_lines": _malformed_lines,
        "converted_domain_breakdown": _converted_domain_breakdown,
        "delivered_hashes": _delivered_hashes,
        "pair_stats_from_catalog": _pair_stats_from_catalog,
        "hash_match_counts_text_days": _hash_match_counts_text_days,
        "audience_run_results": _audience_run_results,
    }
    return own | (llm.queries() | {"pipeline": llm.shipped(corpus_pipeline.run)} if llm else {})


# The derived inputs of FIXTURES.md, as SQL.
_INPUTS = {
    "impressions": """
        select md5(cast(o_custkey as varchar)) as md5, cast(o_orderdate as date) as date_p,
               concat('10.0.0.', cast(o_orderkey % 8 as varchar)) as ip,
               case o_orderkey % 3 when 0 then 'phone' when 1 then 'tablet' end as dev_type,
               concat('maker', cast(o_custkey % 5 as varchar)) as dev_maker,
               concat('browser', cast(o_orderkey % 4 as varchar)) as nbrowser,
               o_orderstatus as os, o_orderpriority as category_id
        from orders""",
    "emails": """
        select case when c_acctbal >= 4500 then md5(cast(c_custkey as varchar))
                    else md5(concat(cast(c_custkey as varchar), 'x')) end as md5, '20240201' as date_p
        from customer, unnest(case when c_acctbal >= 9000 then [0, 1] else [0] end)
        union all select md5(cast(c_custkey as varchar)), '20240101' from customer""",
    "client_mixed": """
        select case c_custkey % 6 when 0 then md5(c_name) when 1 then sha1(c_name) when 2 then sha256(c_name)
                                  when 3 then upper(md5(c_name)) when 4 then null else 'not-a-hash' end as hem
        from customer
        union all select md5(c_name) from customer, unnest(case when c_acctbal >= 9000 then [0] else [] end)""",
    "client_md5": """
        select case when c_nationkey <> 0 then md5(case when c_mktsegment = 'BUILDING' then c_name else concat(c_name, 'x') end) end as hem
        from customer, unnest(case when c_acctbal >= 8000 then [0, 1] else [0] end)""",
    "client_sha1": """
        select sha1(case when c_mktsegment = 'AUTOMOBILE' then c_name else concat(c_name, 'x') end) as sh1
        from customer, unnest(case when c_acctbal >= 8000 then [0, 1] else [0] end)""",
    "client_sha2": """
        select sha256(case when c_mktsegment = 'MACHINERY' then c_name else concat(c_name, 'x') end) as sh2
        from customer, unnest(case when c_acctbal >= 8000 then [0, 1] else [0] end)""",
    "pairs": """
        select md5(c_name) as hem,
               case o_orderkey % 80 when 0 then 'aaid' when 1 then 'idfa'
                                   else cast(100 + o_orderkey % 80 as varchar) end as domain,
               case when n_regionkey = 1 then 'US' else 'EU' end as region,
               case when o_orderdate < timestamp '2001-01-01 00:00:00' then '20001231' else '20010801' end as date_p
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "names": "select cast(100 + n_nationkey as varchar) as id, n_name as name from nation",
    "graph": """
        select case when c_acctbal < 9000 then md5(c_name) else md5(concat(c_name, 'x')) end as hash,
               concat(case when c_custkey % 2 = 0 then 'd' else 'l' end, cast(c_custkey as varchar)) as cookie,
               case when c_custkey % 2 = 0
                    then concat(substring(md5(c_name), 1, 8), '-', substring(md5(c_name), 9, 4), '-',
                                substring(md5(c_name), 13, 4), '-', substring(md5(c_name), 17, 4), '-',
                                substring(md5(c_name), 21, 12))
                    else concat('x', md5(c_name)) end as identifier,
               '20240130' as date_p
        from customer
        union all
        select md5(c_name), concat('d', cast(c_custkey as varchar)), concat('x', md5(c_name)), '20240110'
        from customer""",
    "lookup": """
        select md5(name) as md5, sha1(name) as sh1, sha256(name) as sh2, '20240115' as date_p
        from (select case when c_acctbal >= 0 then c_name else concat(c_name, 'y') end as name from customer)
        union all select md5(c_name), sha1(c_name), sha256(c_name), '20231231' from customer""",
    "weblog": """
        select cast(ts as date) as log_date, cast(100 + event_id % 4 as varchar) as adv_id,
               case when event_id % 5 = 0 then 'null' else concat('d', cast(user_id as varchar)) end as domain_user_id,
               case when event_id % 7 = 0 then null when event_id % 3 = 0 then 'null'
                    else concat('l', cast(user_id as varchar)) end as linked_cookie
        from events""",
    "clusters": """
        select l_orderkey as cluster_id,
               case when l_orderkey % 50 = 0 then 'no-colon-token' when l_orderkey % 17 = 0 then null
                    when l_orderkey % 11 = 0 then concat(tokens, '|') else tokens end as tokens
        from (select l_orderkey,
                     string_agg(concat(case l_suppkey % 4 when 0 then 'aaid' when 1 then 'idfa'
                                                          else cast(l_suppkey % 4 as varchar) end,
                                       ':', cast(l_partkey as varchar)), '|') as tokens
              from lineitem group by l_orderkey)""",
    "file": """
        select cast(c_custkey as varchar) as _c0, c_mktsegment as _c1,
               case when c_custkey % 3 = 0 then null else cast(c_nationkey as varchar) end as _c2
        from customer""",
    "target": 'select event_type as kind, user_id as "user", cast(ts as date) as event_date from events',
    "activity": """
        select user_id as template_id, cast(ts as date) as activity_date, count(*) as decisions
        from events group by 1, 2""",
    "owners": """
        select c_custkey as template_id,
               case when c_nationkey % 2 = 0 then concat(c_name, ' & <"x">') else c_name end as template_name,
               concat(' ', lower(c_mktsegment), '@example.com ') as email_address, c_mktsegment as am_name,
               c_nationkey as publisher_id, n_name as pub_name, r_regionkey as media_group_id,
               r_name as media_group_name
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    # Steps that several answers share.
    "long": """
        select cluster_id, pid, split_part(pid, ':', 1) as domain
        from (select cluster_id, unnest(string_split(tokens, '|')) as pid from clusters)""",
    "stats": """
        select hem, domain, count(*) as pairs, count(case when region = 'US' then 1 end) as us_pairs
        from pairs where date_p = (select max(date_p) from pairs) group by hem, domain""",
    "members": "select distinct md5 from emails where date_p = (select max(date_p) from emails)",
    "recent": """
        select i.*, cast(date_diff('day', i.date_p, date '2001-08-02') as integer) as days_since
        from impressions i join members using (md5)
        where i.date_p between date '2001-08-02' - 181 and date '2001-08-01' and i.date_p <> date '2001-07-15'""",
    "periods": """
        select template_id,
               cast(coalesce(sum(decisions) filter (activity_date = date '2024-01-30'), 0) as bigint) as d1,
               cast(coalesce(sum(decisions) filter (activity_date = date '2024-01-23'), 0) as bigint) as d8,
               cast(coalesce(sum(decisions) filter (activity_date >= date '2024-01-24'), 0) as bigint) as w1,
               cast(coalesce(sum(decisions) filter (activity_date <= date '2024-01-23'), 0) as bigint) as w2
        from activity where activity_date between date '2024-01-17' and date '2024-01-30' group by template_id""",
}
_STEPS = {
    "long": ("clusters",),
    "stats": ("pairs",),
    "members": ("emails",),
    "recent": ("impressions", "emails", "members"),
    "periods": ("activity",),
}


def _with(inputs: str, body: str) -> str:
    """``body`` below the named inputs and whatever they are made of."""
    names: list[str] = []
    for name in inputs.split():
        for needed in (*_STEPS.get(name, ()), name):
            if needed not in names:
                names.append(needed)
    return "with " + ",\n".join(f"{name} as ({_INPUTS[name]})" for name in names) + "\n" + body


_EIGHT = {"min": 0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p85": 0.85, "p90": 0.9, "p95": 0.95, "max": 1}
_FIVE = {name: _EIGHT[name] for name in ("min", "p25", "p50", "p75", "max")}


def _sizes(key: str) -> str:
    return f"select {key}, domain, count(*) as ct from long group by {key}, domain"


def _distribution(key: str, points: dict[str, float], sizes: str) -> str:
    shape = "round(avg(ct), 1) as mean, " + ", ".join(f"quantile_disc(ct, {p}) as {name}" for name, p in points.items())
    maid = f"{sizes} where domain in ('aaid', 'idfa')"
    return f"""
        select 'ALL' as domain, count(distinct {key}) as ct, {shape} from {sizes} having count(*) > 0
        union all select domain, count(*), {shape} from {sizes} group by domain
        union all select 'MAID ALL', count(distinct {key}), {shape} from {maid} having count(distinct domain) = 2"""


def _binned(key: str, digits: int) -> str:
    """Percentiles as the largest size of their bin, by each bin's rank."""
    at = {name: f"min_by(top, bin) filter (rank >= {p} * of)" for name, p in _EIGHT.items()}
    unsure = ", ".join(f"min_by(case when low < top then n else 0 end, bin) filter (rank >= {p} * of)" for p in _EIGHT.values())
    return f"""
        , sizes as ({_sizes(key)}),
        labelled as (
          select 'ALL' as label, * from sizes union all select domain, * from sizes
          union all select 'MAID ALL', * from sizes
          where domain in ('aaid', 'idfa') and (select count(distinct domain) from sizes where domain in ('aaid', 'idfa')) = 2),
        bins as (
          select label, ct - ct % (1 << cast(greatest(0, length(bin(ct)) - {digits}) as bigint)) as bin, count(*) as n, sum(ct) as tokens, min(ct) as low, max(ct) as top
          from labelled group by all),
        ranked as (
          select *, sum(n) over (partition by label order by bin) as rank, sum(n) over (partition by label) as of from bins),
        keys as (select label, count(distinct {key}) as ct from labelled group by label)
        select label as domain, keys.ct, round(sum(tokens) / sum(n), 1) as mean, {", ".join(f"{x} as {name}" for name, x in at.items())},
          round(greatest({unsure}) / max(of), 6) as rank_error
        from ranked join keys using (label) group by label, keys.ct"""


def _report() -> str:
    sides = {"cluster": "cluster_id", "pid": "pid"}
    columns = ", ".join(f"{side}.{name} as {side}_{name}" for side in sides for name in ("ct", "mean", *_EIGHT))
    parts = ", ".join(
        f"{side}_sizes as ({_sizes(key)}), {side} as ({_distribution(key, _EIGHT, f'{side}_sizes')})"
        for side, key in sides.items()
    )
    # The steps are further parts of the same WITH.
    return _with("long", f", {parts} select cluster.domain, {columns} from cluster join pid using (domain)")


def _converted(kind: str) -> str:
    return f"""
        select distinct md5 from lookup join client_{kind} using ({'sh1' if kind == 'sha1' else 'sh2'})
        where date_p = (select max(date_p) from lookup)"""


def _kinds(column: str, rows: str) -> str:
    return f"""
        select case when regexp_matches({column}, '^[a-f0-9]{{32}}$') then 'md5'
                    when regexp_matches({column}, '^[a-f0-9]{{40}}$') then 'sh1'
                    when regexp_matches({column}, '^[a-f0-9]{{64}}$') then 'sh2' else 'invalid' end as h_type,
               count({column}) as n, count(distinct {column}) as n_distinct
        from {rows} group by 1"""


def _breakdown(client: str) -> str:
    return f"""
        select domain, name, count(distinct case when us_pairs > 0 then hem end) as matched_us,
               cast(sum(us_pairs) as bigint) as pairs_us
        from stats join {client} using (hem) left join names on domain = id
        group by domain, name order by pairs_us desc, domain limit 50"""


def _visitors(first: str, last: str) -> str:
    log = f"from weblog where adv_id = '101' and log_date between {first} and {last}"
    return f"""
        select distinct hash as hem from graph
        where date_p = (select max(date_p) from graph)
          and cookie in (select linked_cookie {log} and linked_cookie <> 'null'
                         union select domain_user_id {log} and domain_user_id <> 'null')"""


def _counts_within(windows: tuple[int, ...]) -> str:
    sums = ", ".join(f"cast(sum(case when days_since <= {w} then 1 end) as bigint) as ct_{w}" for w in windows)
    return f"select md5, {sums} from recent group by md5"


def oracle_sql() -> dict[str, str]:
    """The SQL that answers a query, where SQL can express it."""
    own = _own_answers()
    own["match_file"] = own["match_flags"]
    return own | (llm.oracle_sql() if llm else {})


def _own_answers() -> dict[str, str]:
    """The expected answer of each query. ``pids_per_cluster_approx`` has none: its sketch may differ from run to run."""
    counts = _with("recent", _counts_within((30, 60, 90)))
    agents = _with(
        "recent",
        "select md5, ip, dev_type, dev_maker, nbrowser, os, count(*) as ct_45 from recent where days_since <= 45 "
        "group by all",
    )
    categories = _with(
        "recent", "select md5, category_id, count(*) as ct_45 from recent where days_since <= 45 group by all"
    )
    cluster_sizes = f"({_sizes('cluster_id')})"
    return {
        "file_profile": _with(
            "file",
            """
        select '_c0' as "column", count(*) as n_rows, count(distinct _c0) as n_distinct from file
        union all select '_c1', count(*), count(distinct _c1) from file
        union all select '_c2', count(*), count(distinct _c2) from file""",
        ),
        "cluster_file_check": _with(
            "clusters",
            r"""
        select count(*) as n_rows, count(*) - count(case when regexp_matches(tokens, '^(\d+|idfa|aaid):') then 1 end)
                   as n_invalid,
               count(*) > 0 and n_invalid = 0 as is_valid
        from clusters""",
        ),
        "cluster_long_form": _with("long", "select cluster_id, pid, domain from long"),
        "pids_per_cluster": _with("long", _distribution("cluster_id", _EIGHT, cluster_sizes)),
        "pids_per_cluster_five_points": _with("long", _distribution("cluster_id", _FIVE, cluster_sizes)),
        "clusters_per_pid": _with("long", _distribution("pid", _EIGHT, f"({_sizes('pid')})")),
        "cluster_report": _report(),
        "hash_types": _with("client_mixed", _kinds("hem", "client_mixed")),
        "hash_types_from_file": _with("client_mixed", _kinds("hem", "client_mixed")),
        "hash_types_converted": _with("lookup client_sha1", _kinds("md5", f"({_converted('sha1')})")),
        "hash_conversion_sha1": _with("lookup client_sha1", _converted("sha1")),
        "hash_conversion_sha2": _with("lookup client_sha2", _converted("sha2")),
        "pair_stats": _with("stats", "select * from stats"),
        "pair_stats_fixed_snapshot": _with(
            "pairs",
            """
        select hem, domain, count(*) as pairs, count(case when region = 'US' then 1 end) as us_pairs
        from pairs where date_p = '20001231' group by hem, domain""",
        ),
        "match_counts": _with(
            "stats client_md5",
            """
        select count(distinct hem) as matched, count(distinct case when us_pairs > 0 then hem end) as matched_us
        from stats join client_md5 using (hem)""",
        ),
        "domain_breakdown": _with("stats client_md5 names", _breakdown("client_md5")),
        "domain_breakdown_deduped": _with(
            "stats client_md5 names", _breakdown("(select distinct hem from client_md5)")
        ),
        "match_flags": _with(
            "client_md5 graph pairs",
            """
        select distinct c.hem, l.hem is not null as has_linked, m.hem is not null as has_maid
        from client_md5 c
        left join (select hash as hem from graph where date_p = (select max(date_p) from graph) and
                   regexp_matches(identifier, '^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$')) l
               on c.hem = l.hem
        left join (select hem from pairs where date_p = (select max(date_p) from pairs)
                   and domain in ('aaid', 'idfa')) m on c.hem = m.hem""",
        ),
        "cookies_to_hashes": _with("weblog graph", _visitors("date '2024-01-24'", "date '2024-01-30'")),
        "cookies_to_hashes_window": _with("weblog graph", _visitors("date '2024-01-05'", "date '2024-01-20'")),
        "audience_impressions": _with(
            "recent",
            "select md5, ip, dev_type, dev_maker, nbrowser, os, category_id, days_since from recent",
        ),
        "hash_match_counts": counts,
        "hash_match_counts_180": _with("recent", _counts_within((30, 60, 90, 180))),
        "hash_match_counts_incremental": counts,
        "hash_match_counts_redone": counts.replace("and date '2001-08-01'", "and date '2001-07-31'"),
        "user_agent_counts": agents,
        "user_agent_counts_incremental": agents,
        "category_counts": categories,
        "category_counts_incremental": categories,
        "snapshot_load_atomic": _with(
            "target",
            """
        select distinct kind, "user", event_date from target where event_date <> date '2024-01-30'
        union all select distinct 'reloaded', user_id, date '2024-01-30' from events""",
        ),
        "daily_load_csv": "select distinct 'reloaded' as kind, user_id as \"user\", date '2024-01-30' as event_date from events",
        "pids_per_cluster_certified": _with("long", _binned("cluster_id", 2)),
        "clusters_per_pid_certified": _with("long", _binned("pid", 4)),
        "profile_of_days": _with(
            "weblog",
            " union all ".join(
                f"select '{c}' as \"column\", count(*) as n_rows, count(distinct {c}) as n_distinct, true as certified from weblog"
                for c in ("adv_id", "domain_user_id", "linked_cookie")
            ),
        ),
        "file_profile_from_file": _with(
            "file",
            """
        select '_c0' as "column", count(*) as n_rows, count(distinct _c0) as n_distinct from file
        union all select '_c1', count(*), count(distinct _c1) from file
        union all select '_c2', count(*), count(distinct _c2) from file""",
        ),
        "cluster_report_from_file": _report(),
        "malformed_lines": """
        select case when c_custkey % 7 = 0 then 2 else 4 end as n_fields, count(*) as n_lines,
          min(concat(cast(c_custkey as varchar), ';', c_mktsegment, case when c_custkey % 7 = 0 then '' else concat(';', c_name, ';more') end)) as example
        from customer where c_custkey % 7 = 0 or c_custkey % 11 = 0 group by 1""",
        "converted_domain_breakdown": _with(
            "stats lookup client_sha1 names", _breakdown(f"(select md5 as hem from ({_converted('sha1')}))")
        ),
        "delivered_hashes": _with("weblog graph", _visitors("date '2024-01-20'", "date '2024-02-03'")),
        "pair_stats_from_catalog": _with("stats", "select * from stats"),
        "hash_match_counts_text_days": counts,
        "audience_run_results": _with(
            "recent",
            f"""
        select 'hash_match_counts' as result, *, null as ip, null as dev_type, null as dev_maker, null as nbrowser, null as os,
          cast(null as bigint) as ct_45, null as category_id from ({_counts_within((30, 60, 90))})
        union all select 'user_agent_counts', md5, null, null, null, ip, dev_type, dev_maker, nbrowser, os, count(*), null
          from recent where days_since <= 45 group by all
        union all select 'category_counts', md5, null, null, null, null, null, null, null, null, count(*), category_id
          from recent where days_since <= 45 group by all""",
        ),
        "date_coverage": _with(
            "impressions",
            """
        select case when since <= 30 then 30 when since <= 45 then 45 when since <= 60 then 60 when since <= 90 then 90
                    when since <= 180 then 180 else 181 end as date_part, count(distinct since) as dates
        from (select date_diff('day', date_p, date '2001-08-02') as since from impressions)
        where since between 1 and 181 group by 1""",
        ),
        "snapshot_load_timestamps": """
        select distinct event_type as kind, user_id as "user", strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as instant, cast(ts as date) as event_date
        from events where cast(ts as date) not in (date '2024-01-29', date '2024-01-30')
        union all select distinct 'other', user_id, '2024-01-29 07:00:00.000000', date '2024-01-29' from events""",
        "snapshot_load": _with(
            "target",
            """
        select distinct kind, "user", event_date from target where event_date <> date '2024-01-30'
        union all select distinct 'reloaded', user_id, date '2024-01-30' from events""",
        ),
        "period_activity": _with("periods", "select * from periods"),
        "alert_rows": _with(
            "periods owners",
            """
        select trim(email_address) as recipient, 'Templates in decline' as subject,
               case when d1 = 0 then 'did not participate' else 'declined significantly' end as status,
               concat('Hi there ', am_name, ', <br> <br> A template you are the PDM for &mdash; ', replace(replace(replace(replace(template_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), ' (id: ',
                      template_id, ') &mdash; ', status, ' yesterday. Please check it out. <br>',
                      ' <br> <u>Details</u> <br> <br>',
                      ' <b>Media Group Name</b>: ', replace(media_group_name, '&', '&amp;'), ' (id: ', media_group_id,
                      ') <br> <b>Publisher Name</b>: ', pub_name, ' (id: ', publisher_id,
                      ') <br> <b>Template Name</b>: ', replace(replace(replace(replace(template_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), ' (id: ', template_id,
                      ') <br> <b>Decisions Yesterday</b>: ', d1, ' <br> <b>Decisions Same Day Last Week</b>: ', d8,
                      ' <br> <b>Total Decisions This Week</b>: ', w1, ' <br> <b>Total Decisions Last Week</b>: ', w2,
                      ' <br>') as body
        from periods join owners using (template_id) where d8 > 0 and d1 <= d8 * 0.5""",
        ),
    }
