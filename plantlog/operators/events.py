"""Row-level operators on the asset stream: enrichment, filters, validation, delivery form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from plantlog import schema as S
from plantlog.functions import (
    attr_timestamp,
    composite_key,
    iso_ms,
    samples_numeric,
)
from plantlog.functions.jsonfields import with_attributes, without_field
from plantlog.schema import DEFAULT_VOCABULARY, Vocabulary


def enrich(events: DataFrame, partition_by_key: bool = False) -> DataFrame:
    """Readings with their composite key and their timestamp as a column.

    The frame is shuffled by key only on request (before a keyed sink); aggregations and joins
    place their own exchange after partial aggregation.
    """
    out = events.select(
        composite_key().alias("key"), "asset_uuid", "id", "value", "type", "tag",
        attr_timestamp().alias("timestamp"), "partition", "offset")
    return out.repartition("key") if partition_by_key else out


def with_numeric(readings: DataFrame) -> DataFrame:
    return readings.withColumn("value_num", samples_numeric(F.col("value"), F.col("type")))


def known_type(vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    return F.coalesce(F.col("type").isin(*vocab.reading_types), F.lit(False))


# ---- Control signals ---------------------------------------------------------------------

def is_service(vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    return (F.col("id") == S.SERVICE_ID) & (F.col("type") == vocab.platform_type)


def is_asset_type(vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    return (F.col("id") == S.ASSET_TYPE_ID) & (F.col("type") == vocab.platform_type)


def is_availability() -> Column:
    """Availability readings; a NULL value is neither a state nor a delete."""
    return F.col("id").isin(*S.AVAILABILITY_IDS) & F.col("value").isNotNull()


def service_changes(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY,
                    also: tuple[str, ...] = ()) -> DataFrame:
    return events.where(is_service(vocab)).select(
        "asset_uuid", F.col("value").alias("docker_service"), "offset", *also)


def type_changes(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY,
                 also: tuple[str, ...] = ()) -> DataFrame:
    """Type per asset, ``delete`` as a NULL type."""
    return events.where(is_asset_type(vocab)).select(
        "asset_uuid", _null_on_delete().alias("type"), "offset", *also)


def availability_changes(events: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Availability per asset, ``delete`` as a NULL availability."""
    return events.where(is_availability()).select(
        "asset_uuid", _null_on_delete().alias("availability"), "offset", *also)


def _null_on_delete() -> Column:
    return F.when(F.col("value") != S.DELETE, F.col("value"))


def type_tombstones(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    return events.where(is_asset_type(vocab) & (F.col("value") == S.DELETE)).select(
        "asset_uuid", F.lit(None).cast("string").alias("type"), "offset")


def availability_tombstones(events: DataFrame) -> DataFrame:
    return events.where(is_availability() & (F.col("value") == S.DELETE)).select(
        "asset_uuid", F.lit(None).cast("string").alias("value"), "offset")


# ---- Consumption filters -----------------------------------------------------------------

def for_consumer(messages: DataFrame, key: str | None = None, key_column: str = "asset_uuid",
                 predicate: Column | None = None,
                 transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A consumer's view: one key, then the caller's own filter.

    ``predicate`` stays inside the JVM plan; ``transform`` is any DataFrame function (it may
    rewrite rows or drop them, ``mapInPandas`` included).
    """
    out = messages if key is None else messages.where(F.col(key_column) == key)
    if predicate is not None:
        out = out.where(predicate)
    return out if transform is None else out.transform(transform)


# ---- Validation --------------------------------------------------------------------------

def message_error() -> Column:
    """Why a parsed message cannot be delivered, NULL when it can (first reason wins)."""
    return (F.when(F.col("payload").isNull(), "null_payload")
            .when(~F.col("decoded"), "bad_json")
            .when(F.col("asset_uuid").isNull(), "missing_key")
            .when(F.coalesce(F.col("id"), F.lit("")) == "", "missing_id"))


def with_message_error(messages: DataFrame) -> DataFrame:
    """Messages with their ``error``: one pass for a sink that writes both outcomes."""
    return messages.withColumn("error", message_error())


def split_invalid(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deliverable, dead letters with ``error``); both keep the order columns.

    Two frames over one input: whoever needs both at once writes
    :func:`with_message_error` partitioned by ``error`` and so parses once.
    """
    checked = with_message_error(messages)
    return (checked.where(F.col("error").isNull()).drop("error"),
            checked.where(F.col("error").isNotNull()))


# ---- Delivery ----------------------------------------------------------------------------

# Attribute names that consumers of delivered messages read.
STAMPS = ("asset_forwarder_timestamp", "kafka_timestamp", "kafka_timestamp_type")


def delivery_timestamps(messages: DataFrame, forwarded_at: Column) -> DataFrame:
    """Stamp attributes with forwarding time, log time and who set the log time.

    Other attributes are kept. A record without a log time gets only the forwarding time.
    """
    kind = (F.when(F.col("log_time_type") == 0, "producer")
            .when(F.col("log_time_type") == 1, "broker").otherwise("unknown"))
    names = STAMPS
    own = F.map_filter(
        F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>")),
        lambda k, _: ~(k.isin(names[0]) | (F.col("log_time").isNotNull() & k.isin(*names[1:]))))
    forwarded = F.create_map(F.lit(names[0]), iso_ms(forwarded_at))
    logged = F.when(
        F.col("log_time").isNotNull(),
        F.create_map(F.lit(names[1]), iso_ms(F.col("log_time")), F.lit(names[2]), kind),
    ).otherwise(F.create_map().cast("map<string,string>"))
    return messages.withColumn("attributes", F.map_concat(own, forwarded, logged))


def subject_and_payload(messages: DataFrame) -> DataFrame:
    """``subject`` = asset.signal and ``payload`` = the message without its id field (all spellings;
    the last one is the id) and with the stamps of :func:`delivery_timestamps` in its attributes.
    Attributes and fields keep their JSON types."""
    stamps = F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,string>")),
                          lambda k, _: k.isin(*STAMPS))
    return (messages
            .withColumn("subject", F.concat_ws(".", "asset_uuid", "id"))
            .withColumn("payload", with_attributes(without_field(F.col("payload"), "id"), stamps)))
