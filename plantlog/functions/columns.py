"""Column expressions shared by batch and streaming operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plantlog import schema as S

# What counts as a number in a reading; checked before the cast so that SQL-only
# spellings such as '4.5d' stay text.
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def composite_key(asset: Column | str = "asset_uuid", signal: Column | str = "id") -> Column:
    """``asset|signal``; NULL when either part is NULL."""
    asset, signal = (F.col(c) if isinstance(c, str) else c for c in (asset, signal))
    return F.concat(asset.cast("string"), F.lit(S.KEY_SEPARATOR), signal.cast("string"))


def attr_timestamp(attributes: Column | str = "attributes") -> Column:
    """The reading's own timestamp text, or UNAVAILABLE."""
    attributes = F.col(attributes) if isinstance(attributes, str) else attributes
    return F.coalesce(attributes["timestamp"], F.lit(S.UNAVAILABLE))


def numeric_or_null(value: Column) -> Column:
    return F.when(value.rlike(NUMBER_PATTERN), value.try_cast("double"))


def samples_numeric(value: Column, reading_type: Column) -> Column:
    """Numeric form of a Samples reading; NULL for text and for other types."""
    return F.when(reading_type == S.SAMPLES, numeric_or_null(value))


def clean_tag(tag: Column) -> Column:
    """Drop every ``{namespace}`` part."""
    return F.trim(F.regexp_replace(tag, r"\{.*?\}", ""))


def iso_ms(ts: Column) -> Column:
    """ISO-8601 text with milliseconds (microseconds truncated) and ``Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_time(text: Column) -> Column:
    """TIMESTAMP of an ISO text; NULL when it is not one."""
    return text.try_cast("timestamp")


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def from_epoch_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis.cast("bigint"))


def subject_signal(subject: Column) -> Column:
    """Signal id of an ``asset.signal`` subject; the id may hold dots itself."""
    return F.regexp_extract(subject, r"^[^.]*\.(.*)$", 1)
