from plantlog.functions.columns import (
    attr_timestamp,
    clean_tag,
    composite_key,
    epoch_millis,
    from_epoch_millis,
    iso_ms,
    numeric_or_null,
    parse_time,
    samples_numeric,
    subject_signal,
)
from plantlog.functions.jsonfields import fold_fields, folded_field, is_object
from plantlog.functions.ordered import asof_join, lag_in_order, log_micros
from plantlog.functions.sizing import bounded_rows, broadcast_if_bounded

__all__ = [
    "asof_join", "attr_timestamp", "bounded_rows", "broadcast_if_bounded", "clean_tag",
    "composite_key", "epoch_millis", "fold_fields", "folded_field", "from_epoch_millis", "is_object",
    "iso_ms", "lag_in_order", "log_micros", "numeric_or_null", "parse_time", "samples_numeric",
    "subject_signal",
]
