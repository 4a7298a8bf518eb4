"""Sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlog import functions as fn, schema as S, work_dir
from plantlog.functions.jsonfields import field_count
from plantlog.operators import commands, events as E, registration as R, routing, state as St
from plantlog.operators.views import point_lookup, prometheus_targets
from plantlog.schema import DEFAULT_VOCABULARY as V
from plantlog.sources import (
    append_rows,
    as_records,
    changelog_errors,
    from_position,
    parse_asset_events,
    parse_changelog,
    tombstones,
    write_by_cluster,
    write_records,
)
from workload.adapters import CLUSTERS, Tables
from workload.registry import query

# id of a raw record: the last spelling present wins, a JSON null included
_RAW_ID = """CASE WHEN NOT json_valid(value) THEN NULL
  WHEN off % 79 = 0 THEN json_extract_string(value, '$.iD')
  ELSE json_extract_string(value, CASE off % 3 WHEN 0 THEN '$.ID' WHEN 1 THEN '$.id' ELSE '$.Id' END) END"""
_RAW_VALUE = """CASE WHEN json_valid(value) THEN json_extract_string(value,
  CASE off % 3 WHEN 0 THEN '$.VALUE' WHEN 1 THEN '$.value' ELSE '$.Value' END) END"""


@query("scan_asset_stream", f"""
SELECT key AS asset_uuid, {_RAW_ID} AS id, {_RAW_VALUE} AS value,
  CASE WHEN json_valid(value) THEN json_extract_string(value, '$.TAG') END AS tag,
  CASE WHEN json_valid(value) THEN json_extract_string(value, '$.Type') END AS type,
  CASE WHEN json_valid(value) THEN json_extract_string(value, '$.attributes.timestamp') END AS ts_text,
  part, off FROM raw""")
def _(t: Tables):
    return parse_asset_events(t.records).select(
        "asset_uuid", "id", "value", "tag", "type",
        F.col("attributes")["timestamp"].alias("ts_text"), F.col("partition").alias("part"),
        F.col("offset").alias("off"))


@query("scan_uns_map_changelog",
       "SELECT asset_uuid, uns_id, area, workcenter, station FROM curmap")
def _(t: Tables):
    records = t.map_changelog.select(
        F.col("asset_uuid").alias("key"), "offset",
        F.to_json(F.struct(F.col("uns_id").alias("UNS_ID"), F.col("uns_levels").alias("UNS_LEVELS"),
                           (F.col("offset") * 1000).alias("UPDATED_AT"))).alias("value"))
    log = parse_changelog(records, {"uns_id": "string", "uns_levels": "map<string,string>",
                                    "updated_at": "timestamp"})
    level = F.col("uns_levels")
    return St.changelog_snapshot(log).select(
        F.col("k").alias("asset_uuid"), "uns_id",
        *[level[n].alias(n) for n in ("area", "workcenter", "station")])


# every 11th mapping is followed by a record cut in half: it is reported and changes nothing
@query("changelog_errors", """
SELECT asset_uuid AS k, '{"UNS_ID":"cut' AS value, off + 1 AS off, 'undecodable' AS error, true AS kept
FROM mapc WHERE off % 11 = 0""")
def _(t: Tables):
    records = t.map_changelog.select(
        F.col("asset_uuid").alias("key"), "offset", F.to_json(F.struct("uns_id")).alias("value"))
    cut = records.where(F.col("offset") % 11 == 0).select(
        "key", (F.col("offset") + 1).alias("offset"), F.lit('{"UNS_ID":"cut').alias("value"))
    broken = records.unionByName(cut)
    table = St.changelog_snapshot(parse_changelog(broken, {"uns_id": "string"}))
    bad = changelog_errors(broken)
    return bad.join(table.select("k"), "k", "left_semi").select(
        "k", "value", F.col("offset").alias("off"), "error", F.lit(True).alias("kept"))


def _connector_log(t: Tables):
    cfg = t.adapter("cfg")
    puts = cfg.select("asset_uuid", "connector_config", (F.col("key") * 2).alias("offset"))
    gone = cfg.where(F.col("key") % 4 == 0).select("asset_uuid",
                                                  (F.col("key") * 2 + 1).alias("offset"))
    return R.connector_changes(puts, gone)


@query("scan_device_connector", """
SELECT asset_uuid, connector_config FROM cfg WHERE key % 4 <> 0""")
def _(t: Tables):
    records = _connector_log(t).select(
        F.col("k").alias("key"), F.to_json("v").alias("value"), "offset")
    log = parse_changelog(records, {"connector_config": "string"})
    return St.changelog_snapshot(log).withColumnRenamed("k", "asset_uuid")


@query("scan_metrics_targets", """
SELECT uuid AS application_uuid, lower(uuid) AS host,
  CASE WHEN key % 10 = 9 THEN NULL ELSE port END AS port, path FROM app""")
def _(t: Tables):
    port = F.when(F.col("key") % 10 == 9, "n/a").otherwise(F.col("port").cast("string"))
    records = t.adapter("app").select(
        F.col("uuid").alias("key"), "offset", F.to_json(F.struct(
            F.lower("uuid").alias("HOST"), port.alias("PORT"),
            F.col("path").alias("PATH"))).alias("value"))
    log = parse_changelog(records, {"host": "string", "port": "int", "path": "string"})
    return St.changelog_snapshot(log).withColumnRenamed("k", "application_uuid")


@query("source_table_snapshots", """
SELECT 'docker_services' AS name, asset_uuid, docker_service AS current FROM services
UNION ALL SELECT 'assets_type', asset_uuid, type FROM types
UNION ALL SELECT 'assets_avail', asset_uuid, availability FROM avail""")
def _(t: Tables):
    return t.topology(t.control).query("""
        SELECT 'docker_services' AS name, asset_uuid, docker_service AS current FROM docker_services
        UNION ALL SELECT 'assets_type', asset_uuid, type FROM assets_type
        UNION ALL SELECT 'assets_avail', asset_uuid, availability FROM assets_avail""")


@query("start_position", """
SELECT 'earliest' AS start, count(*) AS n, min(off) AS first_off FROM raw
UNION ALL SELECT 'offset', count(*), min(off) FROM raw WHERE off >= 500
UNION ALL SELECT 'latest', 0, NULL FROM raw HAVING count(*) > 0""")
def _(t: Tables):
    def summary(name, start):
        return from_position(t.records, start).agg(
            F.count("*").alias("n"), F.min("offset").alias("first_off")).select(
            F.lit(name).alias("start"), "n", "first_off")
    return summary("earliest", "earliest").unionByName(summary("offset", 500)).unionByName(
        summary("latest", "latest"))


@query("sink_asset_event", """
SELECT asset_uuid AS key, '{"ID":"' || id || '","VALUE":' ||
  coalesce('"' || value || '"', 'null') || ',"TAG":"' || tag || '","TYPE":"' || type ||
  '","attributes":{' || CASE WHEN off % 4 = 0 THEN '"quality":"good","timestamp":"override"'
  WHEN off % 4 = 1 THEN '"timestamp":"' || coalesce(attr_ts, 'UNAVAILABLE') || '","quality":"bad"'
  ELSE '"timestamp":"' || coalesce(attr_ts, 'UNAVAILABLE') || '"' END || '}}' AS value FROM ev""")
def _(t: Tables):
    extra = (F.when(F.col("offset") % 4 == 0, F.create_map(
        F.lit("quality"), F.lit("good"), F.lit("timestamp"), F.lit("override")))
        .when(F.col("offset") % 4 == 1, F.create_map(F.lit("quality"), F.lit("bad"))))
    out = work_dir(t.spark, "asset-events")
    write_records(as_records(E.enrich(t.events), extra), out)
    return t.spark.read.schema("key string, value string").parquet(out)


@query("sink_insert_rows", "SELECT asset_uuid, id, value, tag, type, off FROM ev")
def _(t: Tables):
    out = work_dir(t.spark, "rows")
    rows = t.events.withColumnRenamed("asset_uuid", "ASSET_UUID").drop("log_time")
    append_rows(rows, out, S.ASSET_EVENT)
    return t.spark.read.schema(S.ASSET_EVENT).parquet(out).select(
        "asset_uuid", "id", "value", "tag", "type", F.col("offset").alias("off"))


@query("sink_tombstones", """
SELECT uuid AS application_uuid, port FROM app WHERE replicas <> 2""")
def _(t: Tables):
    log = t.adapter("app").select(F.col("uuid").alias("k"), F.struct("port").alias("v"), "offset")
    out = work_dir(t.spark, "changelog")
    log.write.parquet(out)
    gone = t.adapter("app").where(F.col("replicas") == 2)
    tombstones(gone, "uuid", log.schema["v"].dataType,
               F.col("offset") + 1_000_000_000).write.mode("append").parquet(out)
    return St.changelog_snapshot(t.spark.read.schema(log.schema).parquet(out)).withColumnRenamed(
        "k", "application_uuid")


@query("sink_fanout_partitions", """
SELECT cluster, asset_uuid || '.' || id AS subject, off FROM ev JOIN owner USING (asset_uuid)""")
def _(t: Tables):
    out = work_dir(t.spark, "clusters")
    msgs = t.events.withColumn("subject", F.concat_ws(".", "asset_uuid", "id"))
    # The job runs twice, as after a lost driver: its folder is replaced.
    for _ in range(2):
        write_by_cluster(routing.route(msgs, CLUSTERS).select("cluster", "subject", "offset"), out, job="fan-out")
    return t.spark.read.parquet(out).select("cluster", "subject", F.col("offset").alias("off"))


# ---- Projections -------------------------------------------------------------------------

@query("composite_key", "SELECT key || '|' || id AS key, off FROM (SELECT key, off, "
                        f"{_RAW_ID} AS id FROM raw)")
def _(t: Tables):
    return parse_asset_events(t.records).select(
        fn.composite_key().alias("key"), F.col("offset").alias("off"))


@query("attr_timestamp_default",
       "SELECT off, coalesce(attr_ts, 'UNAVAILABLE') AS timestamp FROM ev")
def _(t: Tables):
    return t.events.select(F.col("offset").alias("off"), fn.attr_timestamp().alias("timestamp"))


_ENRICHED = """SELECT asset_uuid || '|' || id AS key, asset_uuid, id, value, type, tag,
  coalesce(attr_ts, 'UNAVAILABLE') AS timestamp, off FROM ev"""


@query("enrich_asset_stream", _ENRICHED)
def _(t: Tables):
    return E.enrich(t.events).drop("partition").withColumnRenamed("offset", "off")


@query("rename_value_columns", f"""
SELECT 'docker_service' AS col, asset_uuid, value AS current, off FROM ctl
  WHERE id = 'DockerService' AND type = '{V.platform_type}'
UNION ALL SELECT 'type', asset_uuid, nullif(value, 'delete'), off FROM ctl
  WHERE id = 'AssetType' AND type = '{V.platform_type}'
UNION ALL SELECT 'availability', asset_uuid, nullif(value, 'delete'), off FROM ctl
  WHERE id IN ('avail', 'agent_avail') AND value IS NOT NULL""")
def _(t: Tables):
    parts = [(E.service_changes(t.control), "docker_service"), (E.type_changes(t.control), "type"),
             (E.availability_changes(t.control), "availability")]
    frames = [df.select(F.lit(c).alias("col"), "asset_uuid", F.col(c).alias("current"),
                        F.col("offset").alias("off")) for df, c in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("tombstone_projection", f"""
SELECT 'type' AS target, asset_uuid, CAST(NULL AS VARCHAR) AS value, off FROM ctl
  WHERE id = 'AssetType' AND type = '{V.platform_type}' AND value = 'delete'
UNION ALL SELECT 'avail', asset_uuid, NULL, off FROM ctl
  WHERE id IN ('avail', 'agent_avail') AND value = 'delete'""")
def _(t: Tables):
    a = E.type_tombstones(t.control).withColumnRenamed("type", "value")
    b = E.availability_tombstones(t.control)
    return a.withColumn("target", F.lit("type")).unionByName(
        b.withColumn("target", F.lit("avail"))).withColumnRenamed("offset", "off")


@query("rekey_partition_by", "SELECT key, asset_uuid, off FROM (" + _ENRICHED + ")")
def _(t: Tables):
    return E.enrich(t.events, partition_by_key=True).select(
        "key", "asset_uuid", F.col("offset").alias("off"))


@query("normalize_json_case", f"""
SELECT off, json_valid(coalesce(value, '{{')) AS decoded, {_RAW_ID} AS id, {_RAW_VALUE} AS value
FROM raw""")
def _(t: Tables):
    return fn.fold_fields(t.records).select(
        F.col("offset").alias("off"), fn.is_object().alias("decoded"),
        fn.folded_field("id").alias("id"), fn.folded_field("VALUE").alias("value"))


@query("samples_numeric", """
SELECT off, value, CASE WHEN type = 'Samples' THEN TRY_CAST(value AS DOUBLE) END AS value_num
FROM ev""")
def _(t: Tables):
    return E.with_numeric(t.events).select(F.col("offset").alias("off"), "value", "value_num")


@query("clean_tag", "SELECT off, trim(regexp_replace(tag, '\\{.*?\\}', '', 'g')) AS tag FROM ev")
def _(t: Tables):
    return t.events.select(F.col("offset").alias("off"), fn.clean_tag(F.col("tag")).alias("tag"))


@query("iso_ms_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso "
                           "FROM events")
def _(t: Tables):
    return t.table("events").select("event_id", fn.iso_ms(F.col("ts")).alias("iso"))


@query("epoch_millis", """
SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000),
  '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS back FROM events""")
def _(t: Tables):
    ms = fn.epoch_millis(F.col("ts"))
    return t.table("events").select("event_id", ms.alias("ms"),
                                    fn.iso_ms(fn.from_epoch_millis(ms)).alias("back"))


@query("delivery_timestamps", """
SELECT off, CASE WHEN json_valid(value) THEN
    json_extract_string(value, '$.attributes.timestamp') END AS ts_text,
  strftime(ts + INTERVAL 20 MILLISECONDS, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS forwarded,
  CASE WHEN off % 11 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS logged,
  CASE WHEN off % 11 <> 0 THEN CASE ts_kind WHEN 0 THEN 'producer' WHEN 1 THEN 'broker'
    ELSE 'unknown' END END AS kind FROM raw""")
def _(t: Tables):
    msgs = parse_asset_events(t.records).withColumn("sent", F.col("log_time"))
    msgs = msgs.withColumn("log_time", F.when(F.col("offset") % 11 != 0, F.col("log_time")))
    a = F.col("attributes")
    return E.delivery_timestamps(msgs, F.col("sent") + F.expr("INTERVAL 20 MILLISECONDS")).select(
        F.col("offset").alias("off"), a["timestamp"].alias("ts_text"),
        a["asset_forwarder_timestamp"].alias("forwarded"), a["kafka_timestamp"].alias("logged"),
        a["kafka_timestamp_type"].alias("kind"))


_GOOD = f"""SELECT *, {_RAW_ID} AS id FROM raw WHERE json_valid(coalesce(value, '{{'))
  AND key IS NOT NULL AND coalesce({_RAW_ID}, '') <> ''"""


@query("build_subject_payload", f"""
SELECT off, key || '.' || id AS subject, len(json_keys(value)) - CASE WHEN off % 79 = 0 THEN 1
  WHEN off % 7 = 0 THEN 2 ELSE 1 END AS fields, {_RAW_VALUE} AS value FROM ({_GOOD})""")
def _(t: Tables):
    good, _ = E.split_invalid(parse_asset_events(t.records, keep_payload=True))
    sent = E.subject_and_payload(good).select("offset", "subject", "payload")
    return fn.fold_fields(sent, "payload").select(
        F.col("offset").alias("off"), "subject", field_count().cast("bigint").alias("fields"),
        fn.folded_field("value").alias("value"))


@query("split_subject", "SELECT off, id || '.x.1' AS signal FROM ev")
def _(t: Tables):
    subject = F.concat(F.col("asset_uuid"), F.lit("."), F.col("id"), F.lit(".x.1"))
    return t.events.select(F.col("offset").alias("off"), fn.subject_signal(subject).alias("signal"))


@query("type_enum_check", f"""
SELECT type, type IN ('Samples', 'Condition', 'Events', 'Method', '{V.platform_type}', 'UNAVAILABLE')
  AS known, count(*) AS n FROM (SELECT CASE WHEN off % 9 = 0 THEN 'Sample' ELSE type END AS type
  FROM ev) GROUP BY ALL""")
def _(t: Tables):
    df = t.events.withColumn("type", F.when(F.col("offset") % 9 == 0, "Sample").otherwise(
        F.col("type")))
    return df.groupBy("type", E.known_type().alias("known")).agg(F.count("*").alias("n"))


@query("split_invalid_messages", f"""
SELECT off, CASE WHEN value IS NULL THEN 'null_payload' WHEN NOT json_valid(value) THEN 'bad_json'
  WHEN key IS NULL THEN 'missing_key' WHEN coalesce({_RAW_ID}, '') = '' THEN 'missing_id'
  ELSE 'ok' END AS outcome FROM raw""")
def _(t: Tables):
    checked = E.with_message_error(parse_asset_events(t.records, keep_payload=True))
    return checked.select(F.col("offset").alias("off"),
                          F.coalesce("error", F.lit("ok")).alias("outcome"))


@query("prometheus_targets", """
SELECT uuid AS application_uuid, lower(uuid) || ':' || CAST(port AS VARCHAR) AS target,
  coalesce(path, '/metrics') AS path FROM app WHERE replicas = 1
UNION ALL SELECT uuid || '-' || i, lower(uuid) || '-' || i || ':' || CAST(port AS VARCHAR),
  coalesce(path, '/metrics') FROM app, generate_series(1, replicas) g(i) WHERE replicas > 1""")
def _(t: Tables):
    apps = t.adapter("app")
    none = apps.where(F.lit(False)).select(F.col("uuid").alias("application_uuid"), "offset")
    table = St.changelog_snapshot(R.metrics_target_changes(apps, none)).withColumnRenamed(
        "k", "application_uuid")
    return prometheus_targets(table).select(
        "application_uuid", F.col("targets")[0].alias("target"),
        F.col("labels")["__metrics_path__"].alias("path"))


_METHODS = [("move", 0, "x", "int", None, True), ("move", 1, "y", "float", "1.5", False),
            ("stop", 0, "x", "str", None, True), ("stop", 1, "force", "bool", "false", False)]
_PARAM_DDL = "method string, pos int, name string, type string, default string, required boolean"

ENVELOPES = """SELECT *, CASE WHEN error IS NULL THEN json_extract_string(value, '$.arguments.x') END AS x,
  CASE WHEN error IS NULL THEN json_extract_string(value, '$.arguments.y') END AS y FROM (
  SELECT off, asset_uuid, id, value, CASE WHEN NOT json_valid(value) THEN 'bad_json'
  WHEN json_exists(value, '$.extra') THEN 'unknown_field'
  WHEN NOT json_exists(value, '$.header') THEN 'missing_header'
  WHEN json_exists(value, '$.header.role') THEN 'unknown_header_field'
  WHEN NOT regexp_matches(json_extract_string(value, '$.header.correlation_id'),
    '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$') THEN 'bad_correlation_id'
  WHEN TRY_CAST(json_extract_string(value, '$.header.timestamp') AS TIMESTAMP) IS NULL
    THEN 'bad_timestamp'
  WHEN json_type(value, '$.arguments.x') <> 'VARCHAR' THEN 'argument_not_text' END AS error FROM cmd)"""


@query("parse_command_envelope", f"""
SELECT off, error, CASE WHEN error IS NULL THEN
    lower(json_extract_string(value, '$.header.correlation_id')) END AS correlation_id,
  CASE WHEN error IS NULL THEN trim(json_extract_string(value, '$.header.sender_uuid')) END AS sender,
  CASE WHEN error IS NULL THEN 1704067205250 END AS issued_ms, trim(x) AS x, y FROM ({ENVELOPES})""")
def _(t: Tables):
    df = commands.parse_envelopes(t.adapter("cmd"))
    return df.select(F.col("offset").alias("off"), "error", "correlation_id",
                     F.col("sender_uuid").alias("sender"),
                     fn.epoch_millis(F.col("issued_at")).alias("issued_ms"),
                     F.col("arguments")["x"].alias("x"), F.col("arguments")["y"].alias("y"))


def method_parameters(t: Tables):
    return t.spark.createDataFrame(_METHODS, _PARAM_DDL)


BOUND = f"""SELECT off, asset_uuid, method, coalesce(error, CASE
    WHEN x IS NULL THEN 'x:missing_required'
    WHEN method = 'move' AND TRY_CAST(x AS BIGINT) IS NULL THEN 'x:not_int' END) AS error,
  CASE WHEN error IS NULL THEN CASE WHEN method = 'move' THEN CAST(TRY_CAST(x AS BIGINT) AS VARCHAR)
    ELSE x END END AS first_value,
  CASE WHEN error IS NULL THEN CASE WHEN method = 'move' THEN coalesce(y, '1.5') ELSE 'false' END END
    AS second_value FROM (SELECT off, asset_uuid, error, trim(x) AS x, y,
  replace(id, '_CMD', '') AS method FROM ({ENVELOPES}))"""


def bound_columns(df):
    ok = F.col("parse_ok")
    b = F.col("bound")
    return df.select(
        F.col("offset").alias("off"), "asset_uuid", "method", "error",
        F.when(ok, b[0]["value"]).alias("first_value"),
        F.when(ok, b[1]["value"]).alias("second_value"))


@query("bind_command_args", BOUND)
def _(t: Tables):
    parsed = commands.parse_envelopes(commands.command_readings(t.adapter("cmd")))
    bound = commands.bind_arguments(parsed, method_parameters(t))
    df = bound.withColumn("parse_ok", F.col("error").isNull()).withColumn(
        "error", F.coalesce("error", "bind_error"))
    return bound_columns(df)


@query("build_command_events", """
SELECT 'DEV-' || CAST(p_partkey AS VARCHAR) AS asset_uuid, 'move_CMD' AS id,
  '{"header":{"correlation_id":"c' || CAST(p_partkey AS VARCHAR) || '","sender_uuid":"' || p_brand ||
  '","timestamp":"2024-01-01T00:00:00.000Z","signature":null},"arguments":{' || CASE WHEN
  p_partkey % 4 = 0 THEN '' ELSE '"x":"' || CAST(p_size AS VARCHAR) || '"' END || '}}' AS value,
  'Method.Command' AS tag FROM part""")
def _(t: Tables):
    requests = t.table("part").select(
        F.concat(F.lit("DEV-"), F.col("p_partkey").cast("string")).alias("asset_uuid"),
        F.lit("move").alias("method"), F.col("p_brand").alias("sender_uuid"),
        F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("cid"),
        F.when(F.col("p_partkey") % 4 != 0, F.create_map(
            F.lit("x"), F.col("p_size").cast("string"))).alias("arguments"))
    return commands.build_commands(
        requests, F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("cid")).select(
        "asset_uuid", "id", "value", "tag")


@query("replica_uuids", """
SELECT uuid, CASE WHEN replicas = 1 THEN uuid ELSE uuid || '-' || i END AS replica_uuid
FROM app, generate_series(1, replicas) g(i)""")
def _(t: Tables):
    return R.replica_uuids(t.adapter("app")).select("uuid", "replica_uuid")


@query("match_replicas", """
WITH a AS (SELECT 'APP-' || CAST(p_partkey % 500 AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN ''
  WHEN 1 THEN '-1' WHEN 2 THEN '-x' ELSE '-2-3' END AS asset_uuid, p_partkey AS k FROM part)
SELECT app.uuid, a.asset_uuid, a.k FROM a JOIN app
  ON regexp_full_match(a.asset_uuid, app.uuid || '(-\\d+)?')""")
def _(t: Tables):
    k = F.col("p_partkey")
    assets = t.table("part").select(F.concat(
        F.lit("APP-"), (k % 500).cast("string"), F.when(k % 4 == 0, "").when(k % 4 == 1, "-1")
        .when(k % 4 == 2, "-x").otherwise("-2-3")).alias("asset_uuid"), k.alias("k"))
    matched = R.match_replicas(assets.select("asset_uuid").distinct(), t.adapter("app"))
    return assets.join(matched, "asset_uuid").select("uuid", "asset_uuid", "k")


# ---- Filters -----------------------------------------------------------------------------

@query("filter_docker_service", f"""
SELECT asset_uuid, value AS docker_service, off FROM ctl
WHERE id = 'DockerService' AND type = '{V.platform_type}'""")
def _(t: Tables):
    return E.service_changes(t.control).withColumnRenamed("offset", "off")


@query("filter_asset_type", f"""
SELECT asset_uuid, value, off FROM ctl WHERE id = 'AssetType' AND type = '{V.platform_type}'""")
def _(t: Tables):
    return t.control.where(E.is_asset_type()).select(
        "asset_uuid", "value", F.col("offset").alias("off"))


@query("filter_availability", """
SELECT asset_uuid, value, off, value = 'delete' AS removes FROM ctl
WHERE id IN ('avail', 'agent_avail') AND value IS NOT NULL""")
def _(t: Tables):
    return t.control.where(E.is_availability()).select(
        "asset_uuid", "value", F.col("offset").alias("off"),
        (F.col("value") == S.DELETE).alias("removes"))


@query("point_lookup_key", """
SELECT key, value, type FROM state WHERE key = 'ASSET-8|error'""")
def _(t: Tables):
    out = work_dir(t.spark, "state")
    St.write_state(St.latest_state(E.enrich(t.events)), out)
    return point_lookup(t.spark.read.parquet(out), "ASSET-8|error").select("key", "value", "type")


@query("key_and_user_filter", """
SELECT asset_uuid, id, value, off FROM ev WHERE asset_uuid = 'ASSET-8' AND value <> 'UNAVAILABLE'""")
def _(t: Tables):
    return E.for_consumer(t.events, "ASSET-8", predicate=F.col("value") != S.UNAVAILABLE).select(
        "asset_uuid", "id", "value", F.col("offset").alias("off"))


@query("user_message_filter", """
SELECT asset_uuid, upper(id) AS id, CAST(len(value) AS BIGINT) AS width, off FROM ev
WHERE value IS NOT NULL AND type <> 'Condition'""")
def _(t: Tables):
    def keep(df):
        """A user's own filter: may drop rows and rewrite them."""
        def batches(frames):
            for f in frames:
                f = f[f["value"].notna() & (f["type"] != "Condition")]
                yield f.assign(id=f["id"].str.upper(), width=f["value"].str.len())[
                    ["asset_uuid", "id", "width", "offset"]]
        cols = df.select("asset_uuid", "id", "value", "type", "offset")
        return cols.mapInPandas(batches, "asset_uuid string, id string, width bigint, offset bigint")
    return E.for_consumer(t.events, transform=keep).withColumnRenamed("offset", "off")
