"""Readers of the keyed log: Kafka topics or files with the same columns, batch or streaming."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantlog import schema as S
from plantlog.functions.jsonfields import MAP_DDL, fold_fields, folded_field, is_object


def log_records(spark: SparkSession, location: str, *, fmt: str = "parquet",
                streaming: bool = False, start: str | int | dict[int, int] = "earliest",
                per_trigger: int | None = None, **options: str) -> DataFrame:
    """Raw records ``key, value, partition, offset, timestamp, timestampType``.

    ``location`` is a topic for ``fmt="kafka"`` (give ``kafka.bootstrap.servers`` in ``options``)
    and a path otherwise. ``start`` is where reading begins: ``earliest``, ``latest``, one offset for
    all partitions of a file log, or an offset per partition. ``per_trigger`` bounds one micro-batch
    (offsets for Kafka, files otherwise).
    """
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        opts = {"subscribe": location, "startingOffsets": starting_offsets(location, start, streaming),
                **options}
        if streaming and per_trigger:
            opts["maxOffsetsPerTrigger"] = str(per_trigger)
        raw = reader.format("kafka").options(**opts).load()
        return raw.select(F.col("key").cast("string"), F.col("value").cast("string"),
                          "partition", "offset", "timestamp", "timestampType")
    opts = dict(options)
    if streaming and per_trigger:
        opts["maxFilesPerTrigger"] = str(per_trigger)
    raw = reader.format(fmt).schema(S.RAW_RECORD).options(**opts).load(location)
    return from_position(raw, start)


def starting_offsets(topic: str, start: str | int | dict[int, int], streaming: bool) -> str:
    """Kafka's ``startingOffsets``: a word, or JSON with an offset for each partition. Partitions that
    a batch leaves out are an error there, so name them all; ``latest`` starts streams only."""
    if isinstance(start, dict):
        return json.dumps({topic: {str(p): int(o) for p, o in sorted(start.items())}})
    if start == "latest" and not streaming:
        raise ValueError("a batch cannot start at 'latest'")
    if start not in ("earliest", "latest"):
        raise ValueError("a topic has one position per partition: give {partition: offset}")
    return start


def from_position(records: DataFrame, start: int | str | dict[int, int] = "earliest") -> DataFrame:
    """Records from an offset on. ``earliest`` keeps all; ``latest`` means only future records,
    which for a finished log is none. A dict gives each partition its offset; partitions without
    one are read from their beginning."""
    if isinstance(start, dict):
        if not start:
            return records
        at = F.create_map(*[F.lit(int(x)) for item in start.items() for x in item])
        return records.where(F.col("offset") >= F.coalesce(
            F.try_element_at(at, F.col("partition").cast("int")), F.lit(0)))
    if start == "earliest":
        return records
    if start == "latest":
        return records.where(F.lit(False))
    return records.where(F.col("offset") >= int(start))


def parse_asset_events(records: DataFrame, keep_payload: bool = False) -> DataFrame:
    """JSON records as ASSET_EVENT rows; field names in any case, last duplicate wins.

    Fields of an undecodable payload are NULL; :func:`plantlog.operators.events.message_error`
    tells those apart when ``keep_payload`` leaves the raw text in.
    """
    parsed = fold_fields(records)
    columns = [
        F.col("key").alias("asset_uuid"),
        *[folded_field(name).alias(name) for name in ("id", "value", "tag", "type")],
        F.from_json(folded_field("attributes"), MAP_DDL).alias("attributes"),
        F.col("partition"), F.col("offset"), F.col("timestamp").alias("log_time"),
        F.col("timestampType").alias("log_time_type"),
    ]
    if keep_payload:
        columns += [F.col("value").alias("payload"), is_object().alias("decoded")]
    return parsed.select(*columns)


def scan_asset_stream(spark: SparkSession, location: str, **kwargs) -> DataFrame:
    """The asset stream: :func:`log_records` parsed."""
    return parse_asset_events(log_records(spark, location, **kwargs))


def parse_changelog(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Keyed changelog ``(k, v STRUCT or NULL, offset)``, with ``log_time`` where records carry their
    timestamp; a NULL value is a tombstone.

    A value that is no JSON object changes nothing: its row goes to :func:`changelog_errors`.
    ``fields`` maps the struct's field names to Spark types; a value that does not cast is NULL.
    ``map<string,string>`` reads a nested object, ``timestamp`` reads epoch milliseconds.
    """
    def typed(name: str, type_name: str):
        raw = folded_field(name)
        if type_name.replace(" ", "") == MAP_DDL:
            return F.from_json(raw, MAP_DDL)
        if type_name == "timestamp":
            return F.timestamp_millis(raw.try_cast("bigint"))
        return raw.try_cast(type_name)

    value = F.struct(*[typed(n, t).alias(n) for n, t in fields.items()])
    return fold_fields(records).where(F.col("value").isNull() | is_object()).select(
        F.col("key").alias("k"), F.when(is_object(), value).alias("v"), "offset",
        *([F.col("timestamp").alias("log_time")] if "timestamp" in records.columns else []))


def changelog_errors(records: DataFrame) -> DataFrame:
    """Records of a changelog that :func:`parse_changelog` leaves out, with an ``error``."""
    return fold_fields(records).where(F.col("value").isNotNull() & ~is_object()).select(
        F.col("key").alias("k"), "value", "offset", F.lit("undecodable").alias("error"))


def scan_changelog(spark: SparkSession, location: str, fields: dict[str, str],
                   **kwargs) -> DataFrame:
    return parse_changelog(log_records(spark, location, **kwargs), fields)
