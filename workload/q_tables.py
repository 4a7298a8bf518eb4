"""Continuous tables and delivery over logs that grow between runs of their jobs.

Each log is written from the driver's tables in parts; the job runs to the end of its input after every part,
with one checkpoint, so every query shows a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantlog import work_dir
from plantlog.operators import registration as R
from plantlog.operators.routing import route
from plantlog.sources import delivery, log_records, write_records
from plantlog.streaming import for_each_row_batch, stream_latest_state, tables, upsert_sink
from workload.adapters import CLUSTERS, Tables
from workload.registry import query


def grown(t: Tables, name: str, rows: DataFrame, parts: list[Column], run: Callable[[DataFrame], None]) -> None:
    """Appends ``rows`` part by part to a log and runs the job on it after each."""
    log = work_dir(t.spark, f"{name}-log")
    for part in parts:
        rows.where(part).write.mode("append").parquet(log)
        run(t.spark.readStream.schema(rows.schema).parquet(log))


def _halves(rows: DataFrame) -> list[Column]:
    middle = rows.agg(F.percentile_approx("offset", 0.5)).first()[0] or 0
    return [F.col("offset") <= middle, F.col("offset") > middle]


def _table(t: Tables, name: str, rows: DataFrame, parts: list[Column], key: str, payload: list[str], schema: str,
           removed: Column | None = None) -> DataFrame:
    out, checkpoint = work_dir(t.spark, name), work_dir(t.spark, f"{name}-checkpoint")
    grown(t, name, rows, parts, lambda stream: tables.stream_changelog_table(
        tables.changes(stream, key, payload, removed=removed), out, checkpoint).awaitTermination())
    return tables.read_table(t.spark, out, schema, key)


@query("stream_connector_table", """
SELECT asset_uuid, CASE WHEN key % 8 = 0 THEN upper(connector_config) ELSE connector_config END AS connector_config
FROM cfg WHERE key % 4 <> 0 OR key % 8 = 0""")
def _(t: Tables):
    cfg = t.adapter("cfg").withColumn("k", F.col("key"))
    at = lambda n: (F.col("k") * 2 + n).alias("offset")
    puts = cfg.select("asset_uuid", "connector_config", at(0))
    gone = cfg.where("k % 4 = 0").select("asset_uuid", at(1_000_000))
    again = cfg.where("k % 8 = 0").select(F.col("asset_uuid").alias("k"), F.struct(F.upper("connector_config").alias(
        "connector_config")).alias("v"), at(2_000_000))
    log = R.connector_changes(puts, gone).unionByName(again).select(
        F.col("k").alias("asset_uuid"), "v.connector_config", "offset")
    offset = F.col("offset")
    return _table(t, "connectors", log, [offset < 1_000_000, offset.between(1_000_000, 1_999_999), offset >= 2_000_000],
                  "asset_uuid", ["connector_config"], "connector_config string")


@query("stream_uns_map_table", "SELECT asset_uuid, uns_id, area, workcenter, station FROM curmap")
def _(t: Tables):
    level = F.col("uns_levels")
    columns = ["uns_id", "area", "workcenter", "station"]
    log = t.map_changelog.select("asset_uuid", "uns_id", *[level[n].alias(n) for n in columns[1:]], "offset")
    # An unmapped asset stays, with a NULL name.
    return _table(t, "names", log, _halves(log), "asset_uuid", columns, ", ".join(f"{c} string" for c in columns), F.lit(False))


@query("stream_metric_targets", "SELECT uuid AS application_uuid, lower(uuid) AS host, port, path FROM app")
def _(t: Tables):
    log = t.adapter("app").select(F.col("uuid").alias("application_uuid"), F.lower("uuid").alias("host"), "port", "path", "offset")
    return _table(t, "targets", log, _halves(log), "application_uuid", ["host", "port", "path"],
                  f"host string, port {log.schema['port'].dataType.simpleString()}, path string")


@query("stream_changelog_table", """
SELECT asset_uuid, v AS current FROM (SELECT asset_uuid,
  arg_max(struct_pack(v := CASE WHEN off % 5 = 0 THEN NULL ELSE coalesce(value, '-') END), off).v AS v
  FROM ctl GROUP BY 1) WHERE v IS NOT NULL""")
def _(t: Tables):
    log = t.control.select("asset_uuid", F.when(F.col("offset") % 5 != 0, F.coalesce("value", F.lit("-"))).alias(
        "current"), "offset")
    return _table(t, "control", log, _halves(log), "asset_uuid", ["current"], "current string")


def _state(t: Tables) -> str:
    out = work_dir(t.spark, "state-updates")
    stream_latest_state(t.stream_events(), out, work_dir(t.spark, "state-updates-checkpoint")).awaitTermination()
    return out


@query("stream_state_by_uns", """
SELECT m.uns_id || '|' || s.id AS key, m.uns_id, s.asset_uuid, s.id, s.value, s.type, s.tag, s.timestamp
FROM state s JOIN curmap m USING (asset_uuid) WHERE m.uns_id IS NOT NULL""")
def _(t: Tables):
    out, checkpoint, state = work_dir(t.spark, "by-uns"), work_dir(t.spark, "by-uns-checkpoint"), _state(t)
    names = t.map_changelog.select("asset_uuid", "uns_id", "offset")
    grown(t, "by-uns", names, _halves(names), lambda stream: tables.stream_state_by_uns(
        tables.state_updates(t.spark, state), stream, out, checkpoint).awaitTermination())
    return tables.read_state_by_uns(t.spark, out)


@query("stream_readings_by_asset", """
SELECT asset_uuid, count(*) AS n, string_agg(id || '=' || coalesce(value, '?') || '@' || timestamp,
  ';' ORDER BY id) AS readings FROM state GROUP BY 1""")
def _(t: Tables):
    out = work_dir(t.spark, "readings")
    tables.stream_readings_by_asset(tables.state_updates(t.spark, _state(t)), out, work_dir(
        t.spark, "readings-checkpoint")).awaitTermination()
    text = F.transform("readings", lambda r: F.concat(
        r["id"], F.lit("="), F.coalesce(r["value"], F.lit("?")), F.lit("@"), r["timestamp"]))
    return tables.read_readings(t.spark, out).select("asset_uuid", F.size("readings").cast("bigint").alias("n"), F.array_join(
        text, ";").alias("readings"))


def _delivered(t: Tables) -> str:
    out, checkpoint = work_dir(t.spark, "delivery"), work_dir(t.spark, "delivery-checkpoint")
    rows = t.events.select("asset_uuid", "id", "offset")
    grown(t, "delivery", rows, _halves(rows), lambda stream: delivery.deliver(
        route(stream, CLUSTERS).select("asset_uuid", "id", "offset", "cluster"), out, checkpoint).awaitTermination())
    return out


@query("at_least_once", "SELECT asset_uuid, id, off, cluster FROM ev JOIN owner USING (asset_uuid)")
def _(t: Tables):
    return delivery.read_delivered(t.spark, _delivered(t), "asset_uuid string, id string, offset long").select(
        "asset_uuid", "id", F.col("offset").alias("off"), "cluster")


@query("delivered_counters", "SELECT cluster, count(*) AS n FROM ev JOIN owner USING (asset_uuid) GROUP BY 1")
def _(t: Tables):
    return delivery.delivered_counts(t.spark, _delivered(t)).groupBy("cluster").agg(F.sum("rows").alias("n"))


# Every file of the log holds at most RECORDS records, every micro-batch reads FILES of them. Micro-batches of one
# consumer follow each other, so the log is dealt to as many consumers as the cluster runs tasks, CONSUMERS at most.
RECORDS, FILES, CONSUMERS = 1000, 2, 16


def consumed(t: Tables, records: DataFrame, consumers: int) -> DataFrame:
    """Partition and offset of the records, with the ``consumer`` and the ``batch_id`` that read them."""
    log, out, checkpoint = (work_dir(t.spark, n) for n in ("bounded-log", "bounded", "bounded-checkpoint"))
    dealt = F.pmod(F.xxhash64("partition", F.floor(F.col("offset") / RECORDS)), F.lit(consumers)).cast("int")
    write_records(records.select("key", "value", "partition", "offset", "timestamp", "timestampType", dealt.alias("consumer")), log,
                  folders=("consumer",), maxRecordsPerFile=str(RECORDS))
    read = lambda rows: rows.select(F.col("partition").cast("int").alias("part"), "offset")
    # The table is there before its first batch, also for an empty log.
    upsert_sink(f"{out}/consumer=0")(read(records).limit(0), -1)
    written = t.spark.read.schema("consumer int").parquet(log).select("consumer").distinct().collect()
    running = [for_each_row_batch(read(log_records(t.spark, f"{log}/consumer={c}", streaming=True, per_trigger=FILES)),
                                  upsert_sink(f"{out}/consumer={c}"), f"{checkpoint}/{c}") for (c,) in written]
    try:
        for q in running:
            q.awaitTermination()
    finally:
        # Of a failed consumer's log nothing may be missed: the others end with it.
        for q in running:
            q.stop()
    return t.spark.read.parquet(out)


@query("backpressure", "SELECT part, count(*) AS n, true AS bounded FROM raw GROUP BY 1")
def _(t: Tables):
    seen = consumed(t, t.records, min(CONSUMERS, t.spark.sparkContext.defaultParallelism))
    batch = ["consumer", "batch_id"]
    counts = seen.groupBy(*batch, "part").count().withColumn("batch", F.sum("count").over(Window.partitionBy(*batch)))
    return counts.groupBy("part").agg(F.sum("count").alias("n"), (F.max("batch") <= RECORDS * FILES).alias("bounded"))
