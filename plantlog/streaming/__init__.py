from plantlog.streaming.jobs import (
    compact_upserts,
    deliver_by_uns,
    deliver_to_clusters,
    delivery,
    for_each_row_batch,
    push_query,
    read_upserts,
    stream_latest_state,
    stream_table,
    upsert_sink,
)
from plantlog.streaming.stateful import stream_deadband
from plantlog.streaming.subscriptions import message_routes, stream_wait_result, stream_wait_until, wait_until

__all__ = [
    "compact_upserts", "deliver_by_uns", "deliver_to_clusters", "delivery", "for_each_row_batch", "message_routes", "push_query",
    "read_upserts", "stream_deadband", "stream_latest_state", "stream_table",
    "stream_wait_result", "stream_wait_until", "upsert_sink", "wait_until",
]
