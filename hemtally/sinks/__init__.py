"""Where results go: delimited files, and tables replaced a day at a time."""

from hemtally.sinks.daily import load_snapshot, snapshot_rows, write_days
from hemtally.sinks.delimited import write_dated_csv, write_delimited
from hemtally.sinks.versions import DayTable

__all__ = ["DayTable", "load_snapshot", "snapshot_rows", "write_dated_csv", "write_days", "write_delimited"]
