"""Whole jobs: sources, operators and sinks put together, with every path, table and date an argument."""

from hemtally.plans.alerts import decline_alerts
from hemtally.plans.audience_run import audience_run, read_daily_counts, read_run, refresh_daily_counts
from hemtally.plans.cluster_file import cluster_file_report, file_report
from hemtally.plans.cookie_delivery import deliver_cookie_hashes
from hemtally.plans.daily_load import daily_load
from hemtally.plans.hash_report import catalog_pair_stats, client_hashes, converted_hashes, stat_report, write_match_file

__all__ = [
    "audience_run",
    "catalog_pair_stats",
    "client_hashes",
    "cluster_file_report",
    "converted_hashes",
    "daily_load",
    "decline_alerts",
    "deliver_cookie_hashes",
    "file_report",
    "read_daily_counts",
    "read_run",
    "refresh_daily_counts",
    "stat_report",
    "write_match_file",
]
