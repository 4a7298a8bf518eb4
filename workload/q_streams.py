"""Streaming behaviour, subscriptions, ad-hoc SQL. Each stream runs to the end of its input."""

from __future__ import annotations

import operator
from datetime import datetime

from pyspark.sql import functions as F

from plantlog import schema as S, work_dir
from plantlog.operators import commands, events as E, state as St
from plantlog.schema import DEFAULT_VOCABULARY as V
from plantlog.streaming import (
    deliver_by_uns,
    deliver_to_clusters,
    for_each_row_batch,
    message_routes,
    push_query,
    read_upserts,
    stream_deadband,
    stream_latest_state,
    stream_table,
    stream_wait_result,
    stream_wait_until,
    upsert_sink,
    wait_until,
)
from workload.adapters import CLUSTERS, Tables
from workload.q_config import DEADBAND
from workload.q_delivery import _ASOF
from workload.q_events import _RAW_ID, BOUND, bound_columns, method_parameters
from workload.registry import query


def _places(t: Tables, name: str) -> tuple[str, str]:
    return work_dir(t.spark, name), work_dir(t.spark, f"{name}-checkpoint")


@query("push_query", """
SELECT asset_uuid || '|' || id AS key, value, coalesce(attr_ts, 'UNAVAILABLE') AS timestamp, off FROM ev""")
def _(t: Tables):
    out, ckpt = _places(t, "push")
    push_query(E.enrich(t.stream_events()), out, ckpt).awaitTermination()
    return t.spark.read.parquet(out).select("key", "value", "timestamp",
                                            F.col("offset").alias("off"))


@query("pull_query", """
SELECT key AS "KEY", value AS "VALUE", type AS "TYPE" FROM state WHERE type = 'Samples'""")
def _(t: Tables):
    return t.topology().query("SELECT key, value, type FROM assets WHERE type = 'Samples'",
                              upper=True)


@query("sink_push_rows", "SELECT asset_uuid, id, value, off FROM ev WHERE type = 'Events'")
def _(t: Tables):
    out, ckpt = _places(t, "rows")
    rows = t.stream_events().where(F.col("type") == S.EVENTS).select(
        "asset_uuid", "id", "value", F.col("offset").alias("off"))
    for_each_row_batch(rows, upsert_sink(out), ckpt).awaitTermination()
    return t.spark.read.parquet(out).drop("batch_id")


@query("type_subscriptions", """
SELECT 'any' AS route, off, asset_uuid FROM ev
UNION ALL SELECT 'attribute', off, asset_uuid FROM ev WHERE id IN ('view', 'error')
UNION ALL SELECT type, off, asset_uuid FROM ev WHERE type IN ('Samples', 'Events', 'Condition')""")
def _(t: Tables):
    out, ckpt = _places(t, "routes")
    routed = message_routes(t.stream_events(), ["view", "error"]).select(
        "route", F.col("offset").alias("off"), "asset_uuid")
    push_query(routed, out, ckpt).awaitTermination()
    return t.spark.read.parquet(out)


_WAIT = """
SELECT asset_uuid, coalesce(now_hit, false) OR later IS NOT NULL AS matched, coalesce(now_hit, false)
  AS initial, CASE WHEN now_hit THEN now_off ELSE later END AS off FROM (SELECT asset_uuid,
  arg_max(hit, off) FILTER (past) AS now_hit, max(off) FILTER (past) AS now_off,
  min(off) FILTER (hit AND NOT past AND ts <= TIMESTAMP '2024-01-10' + INTERVAL 86400 SECONDS) AS later
  FROM (SELECT asset_uuid, off, ts, ts <= TIMESTAMP '2024-01-10' AS past, {hit} AS hit FROM ev
    WHERE id = '{id}' AND value IS NOT NULL) GROUP BY 1) WHERE now_off IS NOT NULL"""


@query("wait_until_match", _WAIT.format(id="click", hit="value = 'UNAVAILABLE'"))
def _(t: Tables):
    return wait_until(t.events, "click", S.UNAVAILABLE, operator.eq, datetime(2024, 1, 10),
                      86400).withColumnRenamed("offset", "off")


@query("stream_wait_until", _WAIT.format(id="click", hit="value = 'UNAVAILABLE'"))
def _(t: Tables):
    out, ckpt = _places(t, "waits")
    stream_wait_until(t.stream_events(), "click", S.UNAVAILABLE, operator.eq, datetime(2024, 1, 10), 86400,
                      location=out, checkpoint=ckpt).awaitTermination()
    return read_upserts(t.spark, out, ["asset_uuid"]).withColumnRenamed("offset", "off")


@query("stream_wait_result", _WAIT.format(id="click", hit="value = 'UNAVAILABLE'"))
def _(t: Tables):
    out, ckpt = _places(t, "wait-results")
    push_query(stream_wait_result(t.stream_events(), "click", S.UNAVAILABLE, operator.eq, datetime(2024, 1, 10), 86400),
               out, ckpt).awaitTermination()
    return t.spark.read.parquet(out).withColumnRenamed("offset", "off")


@query("user_comparison", _WAIT.format(
    id="purchase", hit="coalesce(TRY_CAST(value AS DOUBLE) >= 150, false)"))
def _(t: Tables):
    return wait_until(t.events, "purchase", 150, operator.ge, datetime(2024, 1, 10),
                      86400).withColumnRenamed("offset", "off")


@query("replay_rebuild", "SELECT key, asset_uuid, id, value, type, tag, timestamp FROM state")
def _(t: Tables):
    out, ckpt = _places(t, "rebuilt")
    stream_latest_state(t.stream_events(), out, ckpt).awaitTermination()
    return read_upserts(t.spark, out, ["key"])


@query("stream_assets_type", "SELECT asset_uuid, type FROM types")
def _(t: Tables):
    out, ckpt = _places(t, "types")
    changes = St.last_change(E.type_changes(t.stream_events("ctl")), "type")
    stream_table(changes, out, ckpt).awaitTermination()
    return read_upserts(t.spark, out, ["asset_uuid"]).where(F.col("type").isNotNull())


@query("stream_by_uns_live", _ASOF)
def _(t: Tables):
    out, ckpt = _places(t, "named")
    deliver_by_uns(t.stream_events(), lambda: t.map_changelog, out, ckpt).awaitTermination()
    return t.spark.read.parquet(out).select("uns_id", "asset_uuid", "id", "value",
                                            F.col("offset").alias("off"))


@query("deliver_to_clusters", f"""
WITH m AS (SELECT *, {_RAW_ID} AS id, CASE WHEN value IS NULL THEN 'null_payload'
  WHEN NOT json_valid(value) THEN 'bad_json' WHEN key IS NULL THEN 'missing_key'
  WHEN coalesce({_RAW_ID}, '') = '' THEN 'missing_id' END AS error FROM raw)
SELECT off, error, CASE WHEN error IS NULL THEN cluster ELSE 'dead_letters' END AS cluster,
  CASE WHEN error IS NULL THEN key || '.' || id END AS subject,
  CASE WHEN error IS NULL THEN '2024-06-01T00:00:00.000Z' END AS stamped
FROM m LEFT JOIN owner ON key = asset_uuid""")
def _(t: Tables):
    out, ckpt = _places(t, "delivered")
    deliver_to_clusters(t.stream_records(), CLUSTERS, out, ckpt, F.lit("2024-06-01").cast("timestamp")
                        ).awaitTermination()
    return t.spark.read.parquet(out).select(
        F.col("offset").alias("off"), "error", "cluster", "subject", F.when(
            F.col("error").isNull(), F.get_json_object(
                "payload", "$.attributes.asset_forwarder_timestamp")).alias("stamped"))


@query("watch_command_stream", BOUND)
def _(t: Tables):
    out, ckpt = _places(t, "commands")
    params = method_parameters(t)

    def run(batch, batch_id):
        done = commands.execute_commands(batch, params).withColumn(
            "parse_ok", F.col("correlation_id").isNotNull())
        upsert_sink(out)(bound_columns(done), batch_id)

    stream = t.stream("cmd").withColumnRenamed("off", "offset")
    for_each_row_batch(stream, run, ckpt).awaitTermination()
    return t.spark.read.parquet(out).drop("batch_id")


@query("deadband_stream", DEADBAND)
def _(t: Tables):
    out, ckpt = _places(t, "deadband")
    rows = t.stream("ev").select("asset_uuid", "id", F.col("off").alias("offset"),
                                 F.col("num").alias("value_num"))
    push_query(stream_deadband(rows, 5.0), out, ckpt).awaitTermination()
    return t.spark.read.parquet(out).select("asset_uuid", "id", F.col("offset").alias("off"),
                                            F.col("value_num").alias("v"))


@query("user_callback", "SELECT asset_uuid || '.' || id AS subject, count(*) AS n FROM ev GROUP BY 1")
def _(t: Tables):
    out, ckpt = _places(t, "callback")

    def on_message(batch, batch_id):
        """A user's callback over a batch of messages."""
        counted = batch.groupBy("subject").agg(F.count("*").alias("n"))
        upsert_sink(out)(counted, batch_id)

    msgs = t.stream_events().select(F.concat_ws(".", "asset_uuid", "id").alias("subject"))
    for_each_row_batch(msgs, on_message, ckpt).awaitTermination()
    return t.spark.read.parquet(out).groupBy("subject").agg(F.sum("n").alias("n"))


@query("adhoc_sql", """
SELECT type, count(*) AS signals, count(DISTINCT asset_uuid) AS assets, max(value) AS top
FROM state GROUP BY 1""")
def _(t: Tables):
    return t.topology().query("""
        SELECT type, count(*) AS signals, count(DISTINCT asset_uuid) AS assets, max(value) AS top
        FROM assets GROUP BY type""")


@query("catalog_listing", """
SELECT 'assets' AS name, 'TABLE' AS kind, 'enriched_assets_stream' AS source,
  (SELECT count(*) FROM state) AS n
UNION ALL SELECT 'assets_stream', 'STREAM', 'events', (SELECT count(*) FROM ev)
UNION ALL SELECT 'asset_to_uns_map', 'TABLE', 'asset_to_uns_map_raw', (SELECT count(*) FROM curmap)
UNION ALL SELECT 'device_connector', 'TABLE', 'device_connector_source', (SELECT count(*) FROM cfg)
UNION ALL SELECT 'metrics_targets', 'TABLE', 'metrics_targets_source', (SELECT count(*) FROM app)""")
def _(t: Tables):
    catalog = t.topology()
    names = ["assets", "assets_stream", "asset_to_uns_map", "device_connector", "metrics_targets"]
    sizes = None
    for n in names:
        one = t.spark.table(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        sizes = one if sizes is None else sizes.unionByName(one)
    return catalog.listing().join(sizes, "name")


@query("derived_views_ddl", """
SELECT asset_uuid, count(*) AS n FROM ev WHERE type = 'Condition' GROUP BY 1""")
def _(t: Tables):
    catalog = t.topology()
    catalog.create("conditions_stream", "STREAM",
                   "SELECT asset_uuid, value FROM assets_stream WHERE type = 'Condition'")
    result = catalog.query("SELECT asset_uuid, count(*) AS n FROM conditions_stream GROUP BY 1")
    catalog.drop("conditions_stream")
    return result
