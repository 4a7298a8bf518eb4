"""Registration and removal of assets, connectors and metric targets as log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantlog import schema as S
from plantlog.functions import epoch_millis
from plantlog.schema import DEFAULT_VOCABULARY, Vocabulary


def _reading(signal: Column | str, value: Column, tag: str, vocab: Vocabulary) -> Column:
    signal = F.lit(signal) if isinstance(signal, str) else signal
    return F.struct(signal.alias("id"), value.cast("string").alias("value"),
                    F.lit(vocab.platform_type).alias("type"), F.lit(tag).alias("tag"))


def register_events(requests: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Readings announcing each ``(asset_uuid, asset_type, docker_service, uns_levels, uns_id)``.

    Four per asset; one more per namespace level and one for the ``uns_id`` where it is given.
    ``seq`` is the order within one registration.
    """
    fixed = F.array(
        _reading(S.ASSET_TYPE_ID, F.col("asset_type"), S.ASSET_TYPE_ID, vocab),
        _reading(S.SERVICE_ID, F.coalesce("docker_service", F.lit("")), S.SERVICE_ID, vocab),
        *[_reading(ref, F.lit(""), S.REFERENCES_TAG, vocab) for ref in S.REFERENCE_IDS])
    levels = F.transform(F.map_entries("uns_levels"),
                         lambda e: _reading(e["key"], e["value"], S.UNS_LEVEL_TAG, vocab))
    named = F.concat(levels, F.array(_reading("uns_id", F.col("uns_id"), S.UNS_ID_TAG, vocab)))
    everything = F.when(F.col("uns_levels").isNull(), fixed).otherwise(F.concat(fixed, named))
    return requests.select("asset_uuid", F.posexplode(everything).alias("seq", "r")).select(
        "asset_uuid", "seq", "r.*")


def register_uns_map(requests: DataFrame, now: Column) -> DataFrame:
    """Map changelog records (key, JSON value) of the registrations that carry a name."""
    value = F.to_json(F.struct(
        F.col("asset_uuid").alias("ASSET_UUID"), F.col("uns_id").alias("UNS_ID"),
        F.col("uns_levels").alias("UNS_LEVELS"), epoch_millis(now).alias("UPDATED_AT")))
    return requests.where(F.col("uns_levels").isNotNull()).select(
        F.col("asset_uuid").alias("key"), value.alias("value"))


def deregister_events(assets: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY,
                      now: Column | None = None) -> DataFrame:
    """Log rows that remove assets, each with the ``target`` it goes to and the ``log_time`` it takes
    effect at: what is registered later stays.

    Blank reference readings go to the stream, tombstones to the three per-asset tables, and a
    NULL name to the map. Signal readings of the asset stay in the state.
    """
    def row(target: str, signal: str | None, value: str | None, tag: str | None) -> Column:
        return F.struct(F.lit(target).alias("target"), F.lit(signal).cast("string").alias("id"),
                        F.lit(value).cast("string").alias("value"),
                        F.lit(vocab.platform_type if tag else None).cast("string").alias("type"),
                        F.lit(tag).cast("string").alias("tag"))

    rows = F.array(
        *[row("assets_stream", ref, "", S.REFERENCES_TAG) for ref in S.REFERENCE_IDS],
        *[row(t, None, None, None) for t in ("assets_type", "assets_avail", "docker_services")],
        row("asset_to_uns_map", "uns_id", None, None))
    at = F.current_timestamp() if now is None else now
    return assets.select("asset_uuid", at.alias("log_time"), F.explode(rows).alias("r")).select(
        "asset_uuid", "log_time", "r.*")


def connector_changes(upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """Connector-configuration changelog from ``(asset_uuid, connector_config, offset)`` upserts
    and ``(asset_uuid, offset)`` removals."""
    put = upserts.select(F.col("asset_uuid").alias("k"),
                         F.struct("connector_config").alias("v"), "offset")
    gone = deletes.select(F.col("asset_uuid").alias("k"),
                          F.lit(None).cast(put.schema["v"].dataType).alias("v"), "offset")
    return put.unionByName(gone)


def replica_uuids(apps: DataFrame) -> DataFrame:
    """One row per replica: the app's own uuid for one replica, ``uuid-1..n`` for more."""
    return apps.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("replicas")))).withColumn(
        "replica_uuid",
        F.when(F.col("replicas") == 1, F.col("uuid")).otherwise(
            F.concat("uuid", F.lit("-"), F.col("_n").cast("string")))).drop("_n")


def match_replicas(assets: DataFrame, apps: DataFrame) -> DataFrame:
    """Assets that belong to an app: its uuid itself or its uuid with a replica number.

    An equi-join on the at most two uuids an asset name can stand for.
    """
    stems = F.array_distinct(F.array(
        F.col("asset_uuid"), F.regexp_replace("asset_uuid", r"-\d+$", "")))
    return assets.select("asset_uuid", F.explode(stems).alias("uuid")).join(
        apps.select("uuid"), "uuid").select("uuid", "asset_uuid")


def metrics_target_changes(apps: DataFrame, deletes: DataFrame) -> DataFrame:
    """Metric-target changelog: one upsert per replica (host is the lower-cased uuid), tombstones
    for removed targets. ``apps`` holds ``uuid, replicas, port, path, offset``."""
    put = replica_uuids(apps).select(
        F.col("replica_uuid").alias("k"),
        F.struct(F.lower("replica_uuid").alias("host"), F.col("port").cast("string").alias("port"),
                 F.coalesce("path", F.lit(S.METRICS_PATH)).alias("path")).alias("v"),
        "offset")
    gone = deletes.select(F.col("application_uuid").alias("k"),
                          F.lit(None).cast(put.schema["v"].dataType).alias("v"), "offset")
    return put.unionByName(gone)
