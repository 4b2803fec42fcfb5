"""The operators: functions from DataFrames to a DataFrame. None of them runs a job or brings rows to the driver."""

from hemtally.operators.alerts import alert_metrics, alert_rows, declining, period_activity
from hemtally.operators.audience import (
    audience_impressions,
    audience_members,
    category_counts,
    daily_counts,
    date_coverage,
    hash_match_counts,
    in_audience,
    lookback,
    matched_counts,
    user_agent_counts,
)
from hemtally.operators.clusters import (
    check_cluster_file,
    check_column_count,
    cluster_report,
    clusters_per_pid,
    explode_clusters,
    pids_per_cluster,
)
from hemtally.operators.hashes import classify_hashes, convert_hashes
from hemtally.operators.matching import domain_breakdown, match_counts, match_flags, matched_stats, pair_stats
from hemtally.operators.profile import merged_profile, preview, profile_file, profile_sketches
from hemtally.operators.weblog import advertiser_cookies, cookies_to_hashes, hashes_of_cookies

__all__ = [
    "advertiser_cookies",
    "alert_metrics",
    "alert_rows",
    "audience_impressions",
    "audience_members",
    "category_counts",
    "check_cluster_file",
    "check_column_count",
    "classify_hashes",
    "cluster_report",
    "clusters_per_pid",
    "convert_hashes",
    "cookies_to_hashes",
    "daily_counts",
    "date_coverage",
    "declining",
    "domain_breakdown",
    "explode_clusters",
    "hash_match_counts",
    "hashes_of_cookies",
    "in_audience",
    "lookback",
    "match_counts",
    "match_flags",
    "matched_counts",
    "matched_stats",
    "merged_profile",
    "pair_stats",
    "period_activity",
    "pids_per_cluster",
    "preview",
    "profile_file",
    "profile_sketches",
    "user_agent_counts",
]
