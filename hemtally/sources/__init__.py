"""Where the input comes from: delimited files, snapshot tables, warehouse queries."""

from hemtally.sources.delimited import day_paths, malformed_lines, malformed_rows, present_paths, read_delimited
from hemtally.sources.shared import WrittenOnce, remove_path, settled, shared_path
from hemtally.sources.snapshots import at_snapshot, latest_partition, latest_snapshot, latest_value
from hemtally.sources.warehouse import jdbc_rows, query_rows

__all__ = [
    "WrittenOnce",
    "at_snapshot",
    "day_paths",
    "jdbc_rows",
    "latest_partition",
    "latest_snapshot",
    "latest_value",
    "malformed_lines",
    "malformed_rows",
    "present_paths",
    "query_rows",
    "read_delimited",
    "remove_path",
    "settled",
    "shared_path",
]
