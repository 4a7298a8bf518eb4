"""Connector configurations and thinning of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlog.functions import iso_ms
from plantlog.operators import connectors as C, sampling
from workload.adapters import Tables
from workload.registry import query

# one row per declared signal, by DuckDB's own JSON functions
SIGNALS = """SELECT asset_uuid, kind, section, name, cfg, node, json_extract_string(node, '$.tag') AS tag,
  json_extract_string(node, '$.node_id') AS node_id, json_extract_string(node, '$.browse_path') AS browse_path
FROM (SELECT asset_uuid, kind, cfg, section, name, json_extract(cfg, '$.' || section || '.' || name) AS node
  FROM (SELECT asset_uuid, kind, cfg, section, unnest(json_keys(cfg, '$.' || section)) AS name
    FROM (SELECT asset_uuid, json_extract(connector_config, '$.connector') AS cfg,
      json_extract_string(connector_config, '$.connector.type') AS kind FROM cfg),
      (VALUES ('constants'), ('variables'), ('events'), ('methods'), ('data')) s(section)
    WHERE json_exists(cfg, '$.' || section)))"""


def parsed(t: Tables):
    return C.parse_configs(t.adapter("cfg").select("asset_uuid", "connector_config"))


def signals(t: Tables):
    return C.connector_signals(parsed(t))


@query("explode_connector_signals", f"""
SELECT asset_uuid, kind AS connector, section, name, tag, node_id, browse_path,
  json_extract_string(node, '$.type') AS type FROM ({SIGNALS})""")
def _(t: Tables):
    return signals(t).select("asset_uuid", "connector", "section", "name", "tag", "node_id",
                             "browse_path", "type")


@query("inherit_subscription_defaults", f"""
SELECT asset_uuid, name, CAST(coalesce(json_extract_string(node, '$.queue_size'),
    json_extract_string(cfg, '$.server.subscription.queue_size'), '1') AS INT) AS queue_size,
  CAST(coalesce(json_extract_string(node, '$.sampling_interval'), '0') AS DOUBLE) AS sampling_interval,
  CAST(coalesce(json_extract_string(node, '$.deadband'), '0') AS DOUBLE) AS deadband,
  coalesce(json_extract_string(node, '$.access_level'), 'ro') AS access_level
FROM ({SIGNALS}) WHERE section = 'variables'""")
def _(t: Tables):
    return C.with_subscription(signals(t)).drop("tag")


@query("parse_node_id", f"""
SELECT asset_uuid, section, name, node_id, ok AS valid,
  CASE WHEN ok THEN CAST(regexp_extract(node_id, '^ns=(\\d+);', 1) AS INT) END AS namespace_index,
  CASE WHEN ok THEN regexp_extract(node_id, ';([is])=', 1) END AS identifier_type,
  CASE WHEN ok THEN regexp_extract(node_id, ';[is]=(.+)$', 1) END AS identifier
FROM (SELECT *, regexp_matches(node_id, '^ns=\\d+;(i|s)=.+$') AS ok FROM ({SIGNALS})
  WHERE node_id IS NOT NULL)""")
def _(t: Tables):
    return C.parse_node_ids(signals(t))


@query("validate_browse_path", f"""
SELECT asset_uuid, section, name, browse_path, CASE
  WHEN string_split(browse_path, '/')[1] <> '0:Root' THEN 'not_from_root'
  WHEN NOT contains(string_split(browse_path, '/')[2], ':') THEN 'no_colon'
  WHEN browse_path LIKE '%/ %' THEN 'outer_space' WHEN browse_path LIKE '% :%' THEN 'space_at_colon'
  WHEN NOT regexp_matches(browse_path, '^0:Root/\\d+:') THEN 'index_not_numeric'
  WHEN browse_path LIKE '%:' THEN 'empty_identifier' END AS error
FROM ({SIGNALS}) WHERE browse_path IS NOT NULL""")
def _(t: Tables):
    return C.browse_path_checks(signals(t))


@query("node_xor_path", f"""
SELECT asset_uuid, section, name, CASE WHEN node_id IS NULL AND browse_path IS NULL THEN 'neither'
  WHEN node_id IS NOT NULL AND browse_path IS NOT NULL THEN 'both' END AS error
FROM ({SIGNALS}) WHERE kind = 'opcua'""")
def _(t: Tables):
    return C.node_address_checks(signals(t))


@query("config_duplicate_nodes", f"""
SELECT asset_uuid, section, coalesce(node_id, browse_path) AS node, count(*) AS uses, string_agg(name, ',' ORDER BY name) AS names
FROM ({SIGNALS}) WHERE kind = 'opcua' AND coalesce(node_id, browse_path) IS NOT NULL
GROUP BY ALL HAVING count(*) > 1""")
def _(t: Tables):
    return C.duplicate_nodes(signals(t)).withColumn("names", F.array_join("names", ","))


@query("config_name_conflicts", f"""
SELECT asset_uuid, name, string_agg(section, ',' ORDER BY section) AS sections, CAST(count(*) AS INT) AS n
FROM (SELECT DISTINCT asset_uuid, name, section FROM ({SIGNALS}) WHERE kind = 'opcua')
GROUP BY ALL HAVING count(*) > 1""")
def _(t: Tables):
    ordered = F.array_join(F.array_sort(F.split("sections", ",")), ",")
    return C.name_conflicts(signals(t)).withColumn("sections", ordered)


@query("mtconnect_source_rules", """
WITH a AS (SELECT asset_uuid, json_extract(connector_config, '$.connector.agent') AS a,
  json_extract_string(connector_config, '$.connector.type') AS kind FROM cfg),
b AS (SELECT asset_uuid, kind, json_exists(a, '$.ip') AS ip, json_exists(a, '$.device_xml') AS xml,
  json_exists(a, '$.adapter') AS ad, json_exists(a, '$.adapter.ip') AS aip,
  json_exists(a, '$.adapter.image') AS aimg FROM a)
SELECT asset_uuid, CASE WHEN NOT ip AND NOT xml THEN 'device_xml_missing' WHEN NOT ip AND NOT ad
  THEN 'adapter_missing' WHEN ip AND ad THEN 'adapter_not_allowed' WHEN ip AND xml
  THEN 'device_xml_not_allowed' END AS agent_error,
  CASE WHEN ad AND aip = aimg THEN 'ip_xor_image' END AS adapter_error FROM b WHERE kind = 'mtconnect'""")
def _(t: Tables):
    return C.mtconnect_checks(parsed(t))


@query("port_range_check", """
SELECT asset_uuid, CAST(json_extract_string(connector_config, '$.connector.port') AS INT) AS port,
  CAST(json_extract_string(connector_config, '$.connector.port') AS INT) BETWEEN 1 AND 65535 AS port_ok,
  CAST(json_extract_string(connector_config, '$.connector.data.click.type')
    NOT IN ('Samples', 'Events') AS INT) AS bad_types
FROM cfg WHERE json_extract_string(connector_config, '$.connector.type') = 'shdr'""")
def _(t: Tables):
    return C.shdr_checks(parsed(t))


@query("connector_signal_tags", f"""
SELECT e.off, e.asset_uuid, e.id, s.tag AS declared_tag, s.type AS declared_type
FROM (SELECT replace(asset_uuid, 'ASSET', 'DEV') AS asset_uuid, id, off FROM ev) e
LEFT JOIN (SELECT asset_uuid, name, tag, json_extract_string(node, '$.type') AS type FROM ({SIGNALS})) s
ON e.asset_uuid = s.asset_uuid AND e.id = s.name""")
def _(t: Tables):
    readings = t.events.withColumn("asset_uuid", F.regexp_replace("asset_uuid", "ASSET", "DEV"))
    return C.label_readings(readings, signals(t)).select(
        F.col("offset").alias("off"), "asset_uuid", "id", "declared_tag", "declared_type")


DEADBAND = """
WITH RECURSIVE s AS (SELECT asset_uuid, id, off, num AS v,
  row_number() OVER (PARTITION BY asset_uuid, id ORDER BY off) AS i FROM ev),
w AS (SELECT asset_uuid, id, off, v, i, v AS kept, true AS keep FROM s WHERE i = 1
  UNION ALL SELECT s.asset_uuid, s.id, s.off, s.v, s.i,
    CASE WHEN abs(s.v - w.kept) < 5 THEN w.kept ELSE s.v END, NOT abs(s.v - w.kept) < 5
  FROM w JOIN s ON s.asset_uuid = w.asset_uuid AND s.id = w.id AND s.i = w.i + 1)
SELECT asset_uuid, id, off, v FROM w WHERE keep"""


def measured(t: Tables):
    return t.adapter("ev").select("asset_uuid", "id", "offset", F.col("num").alias("value_num"))


@query("deadband_filter", DEADBAND)
def _(t: Tables):
    return sampling.deadband_filter(measured(t), 5.0, ["asset_uuid", "id"]).select(
        "asset_uuid", "id", F.col("offset").alias("off"), F.col("value_num").alias("v"))


@query("sample_interval", """
SELECT asset_uuid, id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS slot,
  max(off) AS off, arg_max(tag, off) AS tag FROM ev GROUP BY ALL""")
def _(t: Tables):
    return sampling.sample_interval(t.events, 3600, ["asset_uuid", "id"]).select(
        "asset_uuid", "id", iso_ms(F.col("slot")).alias("slot"), F.col("offset").alias("off"), "tag")
