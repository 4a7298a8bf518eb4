from plantlog.sources.logs import (
    changelog_errors,
    from_position,
    log_records,
    parse_asset_events,
    parse_changelog,
    scan_asset_stream,
    scan_changelog,
    starting_offsets,
)
from plantlog.sources.sinks import (
    append_rows,
    as_records,
    tombstones,
    write_by_cluster,
    write_records,
)

__all__ = [
    "append_rows", "as_records", "changelog_errors", "from_position", "log_records", "parse_asset_events",
    "parse_changelog", "scan_asset_stream", "scan_changelog", "starting_offsets", "tombstones", "write_by_cluster",
    "write_records",
]
