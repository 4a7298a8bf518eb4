"""Derived tables, read views, registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlog import schema as S
from plantlog.operators import events as E, references as Ref, registration as R, state as St
from plantlog.operators import views as Vw
from plantlog.schema import DEFAULT_VOCABULARY as V
from workload.adapters import NAMESPACE, Tables
from workload.registry import query

_STATE = "SELECT key, asset_uuid, id, value, type, tag, timestamp FROM "


def state(t: Tables):
    return St.latest_state(E.enrich(t.events))


def control_state(t: Tables):
    return St.latest_state(E.enrich(t.control))


@query("latest_state", _STATE + "state")
def latest_state(t: Tables):
    return state(t)


@query("latest_state_two_pass", _STATE + "state")
def _(t: Tables):
    return St.latest_state(E.enrich(t.events), strategy="two_pass")


@query("readings_by_asset", """
SELECT asset_uuid, count(*) AS n, string_agg(id || '=' || coalesce(value, '?') || '@' || timestamp,
  ';' ORDER BY id) AS readings FROM state GROUP BY 1""")
def _(t: Tables):
    text = F.transform("readings", lambda r: F.concat(
        r["id"], F.lit("="), F.coalesce(r["value"], F.lit("?")), F.lit("@"), r["timestamp"]))
    return St.readings_by_asset(state(t)).select(
        "asset_uuid", F.size("readings").cast("bigint").alias("n"),
        F.array_join(text, ";").alias("readings"))


@query("changelog_snapshot", """
SELECT asset_uuid, v AS current FROM (SELECT asset_uuid,
  arg_max(struct_pack(v := CASE WHEN off % 5 = 0 THEN NULL ELSE coalesce(value, '-') END), off).v AS v
  FROM ctl GROUP BY 1) WHERE v IS NOT NULL""")
def _(t: Tables):
    v = F.when(F.col("offset") % 5 != 0, F.struct(F.coalesce("value", F.lit("-")).alias("current")))
    log = t.control.select(F.col("asset_uuid").alias("k"), v.alias("v"), "offset")
    return St.changelog_snapshot(log).withColumnRenamed("k", "asset_uuid")


@query("assets_type", "SELECT asset_uuid, type FROM types")
def _(t: Tables):
    return St.assets_type(t.control)


@query("assets_avail", "SELECT asset_uuid, availability FROM avail")
def _(t: Tables):
    return St.assets_avail(t.control)


@query("docker_services", "SELECT asset_uuid, docker_service FROM services")
def _(t: Tables):
    return St.docker_services(t.control)


@query("uns_map", "SELECT asset_uuid, uns_id, workcenter FROM curmap")
def _(t: Tables):
    return St.uns_map(t.map_changelog).select(
        "asset_uuid", "uns_id", F.col("uns_levels")["workcenter"].alias("workcenter"))


@query("distinct_asset_list", "SELECT DISTINCT asset_uuid FROM types")
def _(t: Tables):
    return Vw.distinct_assets(St.assets_type(t.control))


@query("latest_by_timestamp", """
SELECT asset_uuid || '|' || id AS key, arg_max(off, struct_pack(a := coalesce(attr_ts, ''), b := off))
  AS off FROM (SELECT *, off AS o FROM ev) GROUP BY 1""")
def _(t: Tables):
    enriched = E.enrich(t.events).withColumn("value", F.col("offset").cast("string"))
    return St.latest_by_timestamp(enriched).select("key", F.col("value").cast("bigint").alias("off"))


@query("state_as_of", """
SELECT asset_uuid || '|' || id AS key, arg_max(value, off) AS value, arg_max(type, off) AS type
FROM ev WHERE off <= (SELECT max(off) * 4 // 5 FROM ev) GROUP BY 1""")
def _(t: Tables):
    return St.state_as_of(E.enrich(t.events), offset=four_fifths(t)).select("key", "value", "type")


def four_fifths(t: Tables) -> int:
    """A past position that keeps its share of the log at every size."""
    return t.events.agg(F.expr("max(offset) * 4 div 5")).first()[0] or 0


@query("merge_resync", """
WITH cache AS (SELECT asset_uuid || '|' || id AS key, arg_max(value, off) AS value FROM ev
    WHERE off <= (SELECT max(off) * 4 // 5 FROM ev) GROUP BY 1),
  snap AS (SELECT key, value FROM state WHERE type <> 'Condition')
SELECT key, CASE WHEN snap.key IS NOT NULL THEN snap.value ELSE cache.value END AS value
FROM cache FULL JOIN snap USING (key)""")
def _(t: Tables):
    cache = St.state_as_of(E.enrich(t.events), offset=four_fifths(t)).select("key", "value")
    snap = state(t).where(F.col("type") != S.CONDITION).select("key", "value")
    return St.merge_resync(cache, snap, ["key"])


# ---- References --------------------------------------------------------------------------

@query("reference_edges", "SELECT src, direction, CAST(pos AS BIGINT) AS pos, dst FROM edges")
def _(t: Tables):
    return Ref.reference_edges(t.references).withColumn("pos", F.col("pos").cast("bigint"))


@query("reference_neighbors", """
SELECT e.src AS asset_uuid, e.direction, e.dst AS neighbor, s.id, s.value
FROM edges e JOIN cstate s ON s.asset_uuid = e.dst""")
def _(t: Tables):
    return Ref.neighbor_state(Ref.reference_edges(t.references), control_state(t)).select(
        "asset_uuid", "direction", "neighbor", "id", "value")


@query("reference_add", """
SELECT asset_uuid, 'below' AS direction, CASE WHEN trim(value) = '' THEN 'NEW'
  ELSE 'NEW, ' || trim(value) END AS value FROM refs""")
def _(t: Tables):
    new = t.references.select("asset_uuid", F.lit("below").alias("direction"),
                              F.lit("NEW").alias("new_reference"))
    return Ref.add_references(t.references, new)


@query("reference_lists", """
SELECT src, direction, string_agg(dst, ', ' ORDER BY pos) AS value FROM edges GROUP BY ALL""")
def _(t: Tables):
    return Ref.reference_lists(Ref.reference_edges(t.references))


# ---- Views -------------------------------------------------------------------------------

@query("asset_attributes", """
SELECT asset_uuid, id, value, CASE WHEN type = 'Samples' THEN TRY_CAST(value AS DOUBLE) END AS value_num,
  type, tag, timestamp FROM state WHERE type <> 'Method'""")
def _(t: Tables):
    return Vw.asset_attributes(state(t)).drop("key")


def methods(t: Tables):
    enriched = E.enrich(t.adapter("mth").withColumn(
        "attributes", F.create_map().cast("map<string,string>")).withColumn(
        "partition", F.lit(0)))
    return Vw.asset_methods(St.latest_state(enriched))


@query("asset_methods", """
SELECT asset_uuid, id, value, value IS NOT NULL AND json_valid(value) AS is_json FROM mth""")
def _(t: Tables):
    return methods(t).select("asset_uuid", "id", "value", "is_json")


@query("parse_method_contract", """
SELECT asset_uuid, id, CASE WHEN json_valid(value) THEN json_extract_string(value, '$.description') END
  AS description, CASE WHEN json_valid(value) THEN CAST(json_array_length(value, '$.arguments') AS INT)
  END AS arguments FROM mth""")
def _(t: Tables):
    c = F.col("contract")
    return methods(t).select("asset_uuid", "id", c["description"].alias("description"),
                             F.when(c.isNotNull() & F.col("is_json"),
                                    F.size(c["arguments"])).alias("arguments"))


@query("method_arguments_table", """
WITH m AS (SELECT *, CASE WHEN json_valid(value) THEN json_array_length(value, '$.arguments') ELSE 0 END AS n
  FROM mth)
SELECT asset_uuid, id AS method, CASE WHEN json_valid(value) THEN
    json_extract_string(value, '$.description') END AS description,
  CASE WHEN coalesce(n, 0) = 0 THEN '—' ELSE json_extract_string(value, '$.arguments[' || i || '].name')
    || ': ' || json_extract_string(value, '$.arguments[' || i || '].description') END AS argument,
  i AS pos FROM m, generate_series(0, greatest(CAST(coalesce(n, 0) AS BIGINT) - 1, 0)) g(i)""")
def _(t: Tables):
    return Vw.method_arguments(methods(t)).withColumn("pos", F.col("pos").cast("bigint"))


@query("attributes_by_type", """
SELECT 'Samples' AS type, asset_uuid, id, value, regexp_replace(tag, '\\{.*?\\}', '', 'g') AS tag
  FROM state WHERE type = 'Samples'
UNION ALL SELECT 'Events', asset_uuid, id, value, regexp_replace(tag, '\\{.*?\\}', '', 'g')
  FROM state WHERE type = 'Events'
UNION ALL SELECT 'Condition', asset_uuid, id, value, regexp_replace(tag, '\\{.*?\\}', '', 'g')
  FROM state WHERE type = 'Condition'""")
def _(t: Tables):
    s = state(t)
    parts = [Vw.attributes_by_type(s, k).withColumn("type", F.lit(k))
             for k in (S.SAMPLES, S.EVENTS, S.CONDITION)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("asset_inspect", """
SELECT asset_uuid, id, value, CASE type WHEN 'Samples' THEN 'Sample' ELSE type END AS type,
  regexp_replace(tag, '\\{.*?\\}', '', 'g') AS tag FROM state
WHERE type IN ('Samples', 'Events', 'Condition')""")
def _(t: Tables):
    return Vw.asset_inspect(state(t))


@query("asset_wide_view", """
SELECT asset_uuid, coalesce(max(value) FILTER (id = 'click'), 'UNAVAILABLE') AS click,
  coalesce(max(value) FILTER (id = 'error'), 'UNAVAILABLE') AS error,
  coalesce(max(value) FILTER (id = 'speed'), 'UNAVAILABLE') AS speed FROM state GROUP BY 1""")
def _(t: Tables):
    return Vw.asset_wide(state(t), ["click", "error", "speed"])


@query("available_assets", """
SELECT asset_uuid, availability FROM avail WHERE availability IN ('AVAILABLE', 'UNAVAILABLE')""")
def _(t: Tables):
    a = St.assets_avail(t.control)
    both = [Vw.assets_with_availability(a, k).withColumn("availability", F.lit(k))
            for k in (S.AVAILABLE, S.UNAVAILABLE)]
    return both[0].unionByName(both[1])


@query("assets_by_type", """
SELECT 'all' AS asked, asset_uuid, type FROM types UNION ALL
SELECT type, asset_uuid, type FROM types
WHERE type IN ('Device', 'MTConnectAgent', 'KafkaProducer', '""" + V.app_type + "')")
def _(t: Tables):
    types = St.assets_type(t.control)
    out = Vw.assets_of_type(types).withColumn("asked", F.lit("all"))
    for k in V.asset_types:
        out = out.unionByName(Vw.assets_of_type(types, k).withColumn("asked", F.lit(k)))
    return out


@query("discover_by_type", """
WITH w AS (SELECT unnest(['Prometheus.Registry', 'OPCUA.Coordinator', 'SHDR.Coordinator']) AS type),
f AS (SELECT w.type, min(types.asset_uuid) AS asset_uuid FROM w LEFT JOIN types USING (type) GROUP BY 1)
SELECT f.type, f.asset_uuid, a.availability, CASE WHEN f.asset_uuid IS NULL THEN 'not_deployed'
  WHEN coalesce(a.availability, '') <> 'AVAILABLE' THEN 'not_available' END AS error
FROM f LEFT JOIN avail a USING (asset_uuid)""")
def _(t: Tables):
    wanted = t.spark.createDataFrame(
        [("Prometheus.Registry",), ("OPCUA.Coordinator",), ("SHDR.Coordinator",)], "type string")
    return Vw.discover_by_type(St.assets_type(t.control), St.assets_avail(t.control), wanted)


@query("asset_by_service", """
SELECT 'svc-' || CAST(c_custkey AS VARCHAR) AS docker_service, coalesce(min(s.asset_uuid), '') AS asset_uuid
FROM customer LEFT JOIN services s ON s.docker_service = 'svc-' || CAST(c_custkey AS VARCHAR)
GROUP BY 1""")
def _(t: Tables):
    asked = t.table("customer").select(
        F.concat(F.lit("svc-"), F.col("c_custkey").cast("string")).alias("docker_service"))
    return Vw.asset_by_service(St.docker_services(t.control), asked)


@query("full_state_scans", """
SELECT 'avail' AS source, asset_uuid, availability AS current FROM avail
UNION ALL SELECT 'service', asset_uuid, docker_service FROM services""")
def _(t: Tables):
    a = St.assets_avail(t.control).select(F.lit("avail").alias("source"), "asset_uuid",
                                          F.col("availability").alias("current"))
    s = St.docker_services(t.control).select(F.lit("service").alias("source"), "asset_uuid",
                                             F.col("docker_service").alias("current"))
    return a.unionByName(s)


@query("asset_type_lookup", """
SELECT p.asset_uuid, coalesce(t.type, 'UNAVAILABLE') AS type FROM place p LEFT JOIN types t
USING (asset_uuid)""")
def _(t: Tables):
    return Vw.asset_type_lookup(t.adapter("place").select("asset_uuid"), St.assets_type(t.control))


def _wide(*ids: str) -> str:
    cols = ", ".join(f"coalesce(max(s.value) FILTER (s.id = '{i}'), 'UNAVAILABLE') AS {i}" for i in ids)
    return (f"(SELECT t.asset_uuid, t.type, {cols} FROM types t LEFT JOIN cstate s "
            "ON s.asset_uuid = t.asset_uuid GROUP BY ALL)")


@query("asset_listing", f"""
SELECT asset_uuid, uns_id, upper(CASE WHEN type = 'MTConnectAgent' THEN agent_avail ELSE avail END)
  AS availability, type, DockerService AS docker_service
FROM {_wide('uns_id', 'avail', 'agent_avail', 'DockerService')}""")
def _(t: Tables):
    return Vw.asset_listing(St.assets_type(t.control),
                            St.latest_signals(t.control, Vw.ASSET_LISTING_SIGNALS))


@query("device_listing", f"""
WITH r AS (SELECT src, bool_or(dst = src || '-AGENT') AS a, bool_or(dst = src || '-PRODUCER') AS p,
  bool_or(dst = src || '-SUPERVISOR') AS s FROM edges GROUP BY 1)
SELECT asset_uuid, upper(avail) AS availability,
  CASE WHEN a THEN asset_uuid || '-AGENT' ELSE 'NOT DEPLOYED' END AS agent,
  CASE WHEN p THEN asset_uuid || '-PRODUCER' ELSE 'NOT DEPLOYED' END AS producer,
  CASE WHEN s THEN asset_uuid || '-SUPERVISOR' ELSE 'NOT DEPLOYED' END AS supervisor
FROM {_wide('avail')} LEFT JOIN r ON src = asset_uuid WHERE type = 'Device'""")
def _(t: Tables):
    full = St.latest_signals(t.control, Vw.DEVICE_LISTING_SIGNALS).unionByName(t.references)
    return Vw.device_listing(St.assets_type(t.control), full)


@query("app_listing", f"""
SELECT asset_uuid, upper(avail) AS availability, application_manufacturer, application_version,
  application_license FROM {_wide('avail', 'application_manufacturer', 'application_version',
                                  'application_license')} WHERE type = '{V.app_type}'""")
def _(t: Tables):
    return Vw.app_listing(St.assets_type(t.control),
                          St.latest_signals(t.control, Vw.APP_LISTING_SIGNALS))


@query("agent_listing", f"""
SELECT asset_uuid, agent_avail, agent_port FROM {_wide('agent_avail', 'agent_port')}
WHERE type = 'MTConnectAgent'""")
def _(t: Tables):
    return Vw.agent_listing(St.assets_type(t.control),
                            St.latest_signals(t.control, Vw.AGENT_LISTING_SIGNALS))


# ---- Registration ------------------------------------------------------------------------

def requests(t: Tables):
    from plantlog.operators.uns import attach_uns
    return attach_uns(t.provided_levels, NAMESPACE)


VALID = """SELECT asset_uuid, asset_type, coalesce(service, '') AS service, area, workcenter, station,
  coalesce(asset, asset_uuid) AS asset, concat_ws('/', 'Plant', area, workcenter, station,
    coalesce(asset, asset_uuid)) AS uns_id FROM uin WHERE coalesce(inc, 'Plant') = 'Plant'
  AND NOT (workcenter IS NULL AND station IS NOT NULL)
  AND coalesce(station, 'BUILDING') IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')"""


@query("register_events", f"""
WITH v AS ({VALID}), u AS (SELECT uin.asset_uuid, uin.asset_type, coalesce(uin.service, '') AS service
  FROM uin)
SELECT asset_uuid, 'AssetType' AS id, asset_type AS value, 'AssetType' AS tag FROM u
UNION ALL SELECT asset_uuid, 'DockerService', service, 'DockerService' FROM u
UNION ALL SELECT asset_uuid, 'references_below', '', 'AssetsReferences' FROM u
UNION ALL SELECT asset_uuid, 'references_above', '', 'AssetsReferences' FROM u
UNION ALL SELECT asset_uuid, 'uns_id', uns_id, 'UNSId' FROM v
UNION ALL SELECT asset_uuid, 'inc', 'Plant', 'UNSLevel' FROM v
UNION ALL SELECT asset_uuid, 'area', area, 'UNSLevel' FROM v
UNION ALL SELECT asset_uuid, 'workcenter', workcenter, 'UNSLevel' FROM v WHERE workcenter IS NOT NULL
UNION ALL SELECT asset_uuid, 'station', station, 'UNSLevel' FROM v WHERE station IS NOT NULL
UNION ALL SELECT asset_uuid, 'asset', asset, 'UNSLevel' FROM v""")
def _(t: Tables):
    return R.register_events(requests(t)).select("asset_uuid", "id", "value", "tag")


@query("register_uns_map", f"""
SELECT asset_uuid AS key, '{{"ASSET_UUID":"' || asset_uuid || '","UNS_ID":"' || uns_id ||
  '","UNS_LEVELS":{{"inc":"Plant","area":"' || area || '"' ||
  coalesce(',"workcenter":"' || workcenter || '"', '') || coalesce(',"station":"' || station || '"', '')
  || ',"asset":"' || asset || '"}},"UPDATED_AT":1761338400000}}' AS value FROM ({VALID})""")
def _(t: Tables):
    return R.register_uns_map(requests(t), F.timestamp_millis(F.lit(1761338400000)))


@query("deregister_roundtrip", """
WITH stay AS (SELECT asset_uuid FROM place WHERE custkey % 5 <> 0),
  back AS (SELECT asset_uuid, path FROM place WHERE custkey % 10 = 0)
SELECT 'assets_type' AS name, asset_uuid, type AS current FROM types JOIN stay USING (asset_uuid)
UNION ALL SELECT 'assets_avail', asset_uuid, availability FROM avail JOIN stay USING (asset_uuid)
UNION ALL SELECT 'docker_services', asset_uuid, docker_service FROM services JOIN stay USING (asset_uuid)
UNION ALL SELECT 'asset_to_uns_map', asset_uuid, uns_id FROM curmap JOIN stay USING (asset_uuid)
  WHERE uns_id IS NOT NULL
UNION ALL SELECT 'assets_type', asset_uuid, 'Device' FROM back
UNION ALL SELECT 'docker_services', asset_uuid, 'again' FROM back
UNION ALL SELECT 'asset_to_uns_map', asset_uuid, path || '-B' FROM back
UNION ALL SELECT 'assets', asset_uuid, CAST(count(*) AS VARCHAR) FROM (
  SELECT asset_uuid, id FROM ctl WHERE asset_uuid IS NOT NULL AND id IS NOT NULL
  UNION SELECT asset_uuid, unnest(['AssetType', 'DockerService', 'references_below', 'references_above'])
  FROM back) GROUP BY 2""")
def _(t: Tables):
    # Every fifth asset is removed and every tenth comes back a day later: the tombstones have no offset
    # in any log, so log time decides.
    place = t.adapter("place")
    removed, later = (F.lit(day).cast("timestamp") for day in ("2030-01-01", "2030-01-02"))
    gone = R.deregister_events(place.where(F.col("custkey") % 5 == 0), now=removed).where(
        F.col("target") != "assets_stream").select("asset_uuid", "target", "log_time")
    back = place.where(F.col("custkey") % 10 == 0)
    announced = R.register_events(back.select(
        "asset_uuid", F.lit("Device").alias("asset_type"), F.lit("again").alias("docker_service"),
        F.lit(None).cast("map<string,string>").alias("uns_levels"), F.lit(None).cast("string").alias("uns_id")))
    none = F.lit(None).cast("map<string,string>")
    events = t.control.unionByName(announced.select(
        "asset_uuid", "id", "value", "tag", "type", none.alias("attributes"), F.lit(0).alias("partition"),
        (F.col("seq") + 2**40).alias("offset"), later.alias("log_time")))
    names = t.map_changelog.unionByName(back.select(
        "asset_uuid", F.concat("path", F.lit("-B")).alias("uns_id"), none.alias("uns_levels"),
        (F.col("custkey") + 2**40).alias("offset"), later.alias("log_time")))
    # only assets of the name table take part in the comparison of the three tables
    place.select("asset_uuid").createOrReplaceTempView("known_assets")
    return t.topology(events, gone, names).query("""
        SELECT 'assets_type' AS name, asset_uuid, type AS current FROM assets_type
          LEFT SEMI JOIN known_assets USING (asset_uuid)
        UNION ALL SELECT 'assets_avail', asset_uuid, availability FROM assets_avail
          LEFT SEMI JOIN known_assets USING (asset_uuid)
        UNION ALL SELECT 'docker_services', asset_uuid, docker_service FROM docker_services
          LEFT SEMI JOIN known_assets USING (asset_uuid)
        UNION ALL SELECT 'asset_to_uns_map', asset_uuid, uns_id FROM asset_to_uns_map
          WHERE uns_id IS NOT NULL
        UNION ALL SELECT 'assets', asset_uuid, CAST(count(*) AS STRING) FROM assets GROUP BY asset_uuid""")


@query("deregister_events", """
SELECT asset_uuid, target, id, value, tag FROM place, (VALUES
  ('assets_stream', 'references_below', '', 'AssetsReferences'),
  ('assets_stream', 'references_above', '', 'AssetsReferences'),
  ('assets_type', NULL, NULL, NULL), ('assets_avail', NULL, NULL, NULL),
  ('docker_services', NULL, NULL, NULL), ('asset_to_uns_map', 'uns_id', NULL, NULL))
  d(target, id, value, tag)""")
def _(t: Tables):
    return R.deregister_events(t.adapter("place")).select(
        "asset_uuid", "target", "id", "value", "tag")


@query("connector_upsert_delete", """
SELECT asset_uuid, connector_config FROM cfg WHERE key % 6 <> 1""")
def _(t: Tables):
    cfg = t.adapter("cfg")
    log = R.connector_changes(
        cfg.select("asset_uuid", "connector_config", "offset"),
        cfg.where(F.col("key") % 6 == 1).select(
            "asset_uuid", (F.col("offset") + 1_000_000_000).alias("offset")))
    return St.changelog_snapshot(log).withColumnRenamed("k", "asset_uuid")


@query("metrics_target_upsert_delete", """
SELECT r AS application_uuid, lower(r) AS host, CAST(port AS VARCHAR) AS port,
  coalesce(path, '/metrics') AS path FROM (SELECT *, CASE WHEN replicas = 1 THEN uuid ELSE uuid || '-' || i
  END AS r FROM app, generate_series(1, replicas) g(i)) WHERE NOT (key % 5 = 0 AND (r = uuid OR i = 1))""")
def _(t: Tables):
    apps = t.adapter("app")
    gone = apps.where(F.col("key") % 5 == 0).select(
        F.when(F.col("replicas") == 1, F.col("uuid")).otherwise(
            F.concat("uuid", F.lit("-1"))).alias("application_uuid"),
        (F.col("offset") + 1_000_000_000).alias("offset"))
    return St.changelog_snapshot(R.metrics_target_changes(apps, gone)).withColumnRenamed(
        "k", "application_uuid")
