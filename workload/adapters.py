"""The driver's tables as asset events.

Every adapter is a list of SQL expressions valid in both engines, so Spark and DuckDB see the same
input. Deterministic modulo rules inject NULLs, deletes, broken JSON and other edge rows; they
shape the input and never select part of it.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plantlog import configure
from plantlog.operators.routing import route
from plantlog.operators.uns import ANY, Namespace
from plantlog.plans import Catalog, build_topology
from plantlog.schema import DEFAULT_VOCABULARY as V

CLUSTERS = ["C1", "C2", "C3"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NAMESPACE = Namespace(
    levels={"inc": "Plant", "area": ANY, "workcenter": ANY, "station": SEGMENTS, "asset": ANY,
            "attribute": ANY},
    template="inc/area/workcenter/station/asset/attribute")
LEVELS = list(NAMESPACE.fields)

# The driver's tables, declared so that no reader opens files to infer a schema.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}

_SPARK_ISO = "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
_DUCK_ISO = "(strftime({0}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z')"


def _render(expr: str, iso: str) -> str:
    return re.sub(r"ISO\(([^)]*)\)", lambda m: iso.format(m.group(1)), expr)


# name -> (base, [(column, expression)])
ADAPTERS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "ev": ("events", [
        ("asset_uuid", "'ASSET-' || CAST(user_id AS STRING)"),
        ("id", "event_type"),
        ("value", "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'UNAVAILABLE' "
                  "ELSE CAST(value AS STRING) END"),
        ("tag", "CASE WHEN event_id % 2 = 0 THEN '{urn:x:' || event_type || '}' || event_type "
                "ELSE event_type END"),
        ("type", "CASE event_type WHEN 'purchase' THEN 'Samples' WHEN 'view' THEN 'Samples' "
                 "WHEN 'click' THEN 'Events' WHEN 'error' THEN 'Condition' "
                 f"ELSE '{V.platform_type}' END"),
        ("attr_ts", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE ISO(ts) END"),
        ("part", "CAST(user_id % 4 AS INT)"),
        ("off", "event_id"),
        ("ts", "ts"),
        ("num", "value"),
    ]),
    # one JSON record per event: field names in three cases, a duplicate id, broken text
    "raw": ("events", [
        ("key", "CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'ASSET-' || CAST(user_id AS STRING) END"),
        ("value", "CASE WHEN event_id % 103 = 0 THEN NULL "
                  "WHEN event_id % 101 = 0 THEN '{\"ID\":\"' || event_type ELSE '{' || "
                  "CASE WHEN event_id % 7 = 0 THEN '\"iD\":\"first\",' ELSE '' END || "
                  "CASE WHEN event_id % 79 = 0 THEN '' ELSE "
                  "CASE event_id % 3 WHEN 0 THEN '\"ID\"' WHEN 1 THEN '\"id\"' ELSE '\"Id\"' END || ':' || "
                  "CASE WHEN event_id % 89 = 0 THEN '\"\"' WHEN event_id % 83 = 0 THEN 'null' "
                  "ELSE '\"' || event_type || '\"' END || ',' END || "
                  "CASE event_id % 3 WHEN 0 THEN '\"VALUE\"' WHEN 1 THEN '\"value\"' ELSE '\"Value\"' END "
                  "|| ':\"' || CAST(value AS STRING) || '\",\"TAG\":\"' || event_type || "
                  "'\",\"Type\":\"Samples\",\"attributes\":{' || CASE WHEN event_id % 10 = 0 THEN '' "
                  "ELSE '\"timestamp\":\"' || ISO(ts) || '\"' END || '}}' END"),
        ("part", "CAST(user_id % 4 AS INT)"),
        ("off", "event_id"),
        ("ts", "ts"),
        ("ts_kind", "CAST(event_id % 3 AS INT)"),
    ]),
    # control signals
    "ctl": ("orders", [
        ("asset_uuid", "'ASSET-' || CAST(o_custkey AS STRING)"),
        ("id", "CASE o_orderkey % 5 WHEN 0 THEN 'AssetType' WHEN 1 THEN 'avail' "
               "WHEN 2 THEN 'agent_avail' WHEN 3 THEN 'DockerService' ELSE "
               "CASE o_orderkey % 7 WHEN 0 THEN 'application_manufacturer' "
               "WHEN 1 THEN 'application_version' WHEN 2 THEN 'application_license' "
               "WHEN 3 THEN 'agent_port' ELSE 'uns_id' END END"),
        ("value", "CASE o_orderkey % 5 WHEN 0 THEN CASE "
                  "WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'delete' "
                  "WHEN o_orderkey % 8 IN (0, 4) THEN 'Device' "
                  "WHEN o_orderkey % 8 IN (1, 5) THEN 'MTConnectAgent' "
                  "WHEN o_orderkey % 8 = 2 THEN 'KafkaProducer' "
                  f"WHEN o_orderkey % 8 = 3 THEN '{V.app_type}' "
                  "WHEN o_orderkey % 8 = 6 THEN 'OPCUA.Coordinator' ELSE 'Prometheus.Registry' END "
                  "WHEN 3 THEN 'svc-' || CAST(o_custkey AS STRING) "
                  "WHEN 4 THEN o_orderpriority ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'delete' "
                  "WHEN o_orderkey % 7 = 6 THEN 'available' WHEN o_orderkey % 7 = 5 THEN NULL "
                  "WHEN o_orderkey % 2 = 0 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END END"),
        ("tag", "CASE o_orderkey % 5 WHEN 0 THEN 'AssetType' WHEN 3 THEN 'DockerService' "
                "ELSE '{urn:x}Availability' END"),
        ("type", f"CASE WHEN o_orderkey % 5 IN (0, 3) THEN '{V.platform_type}' ELSE 'Events' END"),
        ("attr_ts", "ISO(o_orderdate)"),
        ("part", "CAST(o_custkey % 4 AS INT)"),
        ("off", "o_orderkey"),
        ("ts", "o_orderdate"),
    ]),
    # levels an asset provides; NULL = not provided
    "uin": ("places", [
        ("asset_uuid", "'ASSET-' || CAST(c_custkey AS STRING)"),
        ("inc", "CASE WHEN c_custkey % 11 = 0 THEN 'WRONG' WHEN c_custkey % 2 = 0 THEN 'Plant' END"),
        ("area", "r_name"),
        ("workcenter", "CASE WHEN c_custkey % 7 = 0 OR c_custkey % 13 = 0 THEN NULL ELSE n_name END"),
        ("station", "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'BAD' "
                    "ELSE c_mktsegment END"),
        ("asset", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'M' || CAST(c_custkey AS STRING) END"),
        ("asset_type", "CASE WHEN c_custkey % 2 = 0 THEN 'Device' ELSE 'MTConnectAgent' END"),
        ("service", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'svc-' || CAST(c_custkey AS STRING) END"),
    ]),
    "place": ("places", [
        ("asset_uuid", "'ASSET-' || CAST(c_custkey AS STRING)"),
        ("custkey", "c_custkey"),
        ("area", "r_name"), ("workcenter", "n_name"), ("station", "c_mktsegment"),
        ("line_id", "'Plant/' || r_name || '/' || n_name || '/' || c_mktsegment"),
        ("path", "'Plant/' || r_name || '/' || n_name || '/' || c_mktsegment || '/ASSET-' "
                 "|| CAST(c_custkey AS STRING)"),
    ]),
    # commands: envelopes with every kind of fault
    "cmd": ("part", [
        ("asset_uuid", "'APP-' || CAST(p_partkey % 50 AS STRING)"),
        ("id", "CASE WHEN p_partkey % 2 = 0 THEN 'move_CMD' ELSE 'stop_CMD' END"),
        ("value", "CASE WHEN p_partkey % 19 = 0 THEN '{\"header\":' ELSE '{' || "
                  "CASE WHEN p_partkey % 17 = 0 THEN '\"extra\":1' || CASE WHEN p_partkey % 65 = 0 THEN '' "
                  "ELSE ',' END ELSE '' END || "
                  "CASE WHEN p_partkey % 13 = 0 THEN '' ELSE '\"header\":{\"correlation_id\":\"' || "
                  "CASE WHEN p_partkey % 7 = 0 THEN 'not-a-uuid' ELSE "
                  "lpad(CAST(p_partkey AS STRING), 8, '0') || '-0000-4000-8000-00000000000A' END || "
                  "'\",\"sender_uuid\":\"  ASSET-' || CAST(p_partkey AS STRING) || ' \",\"timestamp\":\"' || "
                  "CASE WHEN p_partkey % 11 = 0 THEN 'yesterday' ELSE '2024-01-01T00:00:05.250Z' END || '\"' || "
                  "CASE WHEN p_partkey % 23 = 0 THEN ',\"role\":\"x\"' ELSE '' END || '}' END || "
                  "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE "
                  "CASE WHEN p_partkey % 13 = 0 THEN '' ELSE ',' END || '\"arguments\":{\"x\":' || "
                  "CASE WHEN p_partkey % 29 = 0 THEN '7' WHEN p_partkey % 31 = 0 THEN '\"abc\"' "
                  "ELSE '\" ' || CAST(p_size AS STRING) || '\"' END || "
                  "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',\"y\":\"' || CAST(p_retailprice AS STRING) "
                  "|| '\"' END || '}' END || '}' END"),
        ("tag", "'Method.Command'"),
        ("type", f"'{V.platform_type}'"),
        ("off", "p_partkey"),
    ]),
    # connector documents of three kinds
    "cfg": ("part", [
        ("asset_uuid", "'DEV-' || CAST(p_partkey AS STRING)"),
        ("connector_config",
         "'{\"uuid\":\"DEV-' || CAST(p_partkey AS STRING) || '\",\"connector\":' || CASE p_partkey % 3 "
         "WHEN 0 THEN '{\"type\":\"opcua\",\"server\":{\"uri\":\"opc.tcp://h\"' || "
         "CASE WHEN p_partkey % 2 = 0 THEN ',\"subscription\":{\"queue_size\":' || CAST(p_size AS STRING) "
         "|| '}' ELSE '' END || '},\"constants\":{\"' || "
         "CASE WHEN p_partkey % 7 = 0 THEN 'v1' ELSE 'serial' END || '\":{\"node_id\":\"ns=3;s=Serial\","
         "\"tag\":\"SerialNumber\"}},\"variables\":{\"v1\":{\"node_id\":\"' || "
         "CASE WHEN p_partkey % 11 = 0 THEN 'ns=x;i=1' ELSE 'ns=3;i=' || CAST(p_partkey AS STRING) END || "
         "'\",\"tag\":\"' || p_type || '\",\"queue_size\":5,\"deadband\":0.5},\"v2\":{\"browse_path\":\"' || "
         "CASE p_partkey % 10 WHEN 1 THEN '1:Root/2:A' WHEN 2 THEN '0:Root/2A' WHEN 3 THEN '0:Root/ 2:A' "
         "WHEN 4 THEN '0:Root/2 :A' WHEN 5 THEN '0:Root/x:A' WHEN 6 THEN '0:Root/2:' "
         "ELSE '0:Root/2:A/3:B' END || '\",\"tag\":\"Pos\",\"sampling_interval\":250.0},\"v3\":{' || "
         "CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN '\"node_id\":\"ns=1;i=1\","
         "\"browse_path\":\"0:Root/1:Z\",' WHEN p_partkey % 5 = 0 THEN '\"node_id\":\"ns=3;i=' || "
         "CAST(p_partkey AS STRING) || '\",' ELSE '\"node_id\":\"ns=4;s=T.v\",' END || "
         "'\"tag\":\"Temp\",\"access_level\":\"rw\"}},\"methods\":{\"' || "
         "CASE WHEN p_partkey % 19 = 0 THEN 'v2' ELSE 'run' END || '\":{\"node_id\":\"ns=3;i=9\"}}}' "
         "WHEN 1 THEN '{\"type\":\"shdr\",\"host\":\"h\",\"port\":' || CASE WHEN p_partkey % 8 = 0 THEN '70000' "
         "ELSE '7878' END || ',\"data\":{\"purchase\":{\"tag\":\"' || p_type || '\",\"type\":\"Samples\"},"
         "\"click\":{\"tag\":\"Click\",\"type\":\"' || CASE WHEN p_partkey % 14 = 0 THEN 'Condition' "
         "ELSE 'Events' END || '\"}}}' "
         "ELSE '{\"type\":\"mtconnect\",\"agent\":{\"port\":5000' || "
         "CASE WHEN p_partkey % 2 = 0 THEN ',\"ip\":\"10.0.0.1\"' ELSE '' END || "
         "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ',\"device_xml\":\"d.xml\"' END || "
         "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ',\"adapter\":{\"port\":7878' || "
         "CASE p_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN ',\"ip\":\"a\",\"image\":\"b\"' "
         "WHEN 2 THEN ',\"image\":\"b\"' ELSE ',\"ip\":\"a\"' END || '}' END || '}}' END || '}'"),
        ("off", "p_partkey"),
        ("key", "p_partkey"),
    ]),
    "app": ("supplier", [
        ("uuid", "'APP-' || CAST(s_suppkey AS STRING)"),
        ("replicas", "CAST(s_suppkey % 3 + 1 AS INT)"),
        ("port", "CAST(4000 + s_suppkey % 10 AS INT)"),
        ("path", "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE '/m' || CAST(s_suppkey % 4 AS STRING) END"),
        ("off", "s_suppkey"),
        ("key", "s_suppkey"),
    ]),
    # method contracts, some not JSON, some without arguments
    "mth": ("part", [
        ("asset_uuid", "'APP-' || CAST(p_partkey % 50 AS STRING)"),
        ("id", "'m' || CAST(p_partkey AS STRING)"),
        ("value", "CASE WHEN p_partkey % 9 = 0 THEN 'run ' || p_name WHEN p_partkey % 8 = 0 THEN NULL ELSE "
                  "'{\"description\":\"' || p_name || '\",\"arguments\":[' || "
                  "CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '{\"name\":\"x\",\"description\":\"' || p_type "
                  "|| '\"}' ELSE '{\"name\":\"x\",\"description\":\"\"},{\"name\":\"y\",\"description\":\"Y\"}' "
                  "END || ']}' END"),
        ("tag", "'Method'"), ("type", "'Method'"),
        ("off", "p_partkey"),
    ]),
}

# Offsets between the rounds in which the fixture's name map changes; a round has a row per place.
MAP_STEP = 10_000_000_000


def _at_minute(minute: int) -> str:
    """Log time of a place's mapping, counted from the first day of the readings."""
    return f"TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(custkey * 10 + {minute} AS BIGINT))"


_PLACES = ("SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey "
           "JOIN region ON n_regionkey = r_regionkey")

# Further shared inputs, written for DuckDB; their Spark form is a method of Tables.
CTES: dict[str, str] = {
    name: "SELECT " + ", ".join(f"{_render(e, _DUCK_ISO)} AS {c}" for c, e in cols)
          + f" FROM {base}"
    for name, (base, cols) in ADAPTERS.items()}
CTES["places"] = _PLACES
# The map is a log of its own: its offsets start at 0 and have nothing to do with those of the readings.
CTES["mapc"] = f"""
  SELECT asset_uuid, path AS uns_id, area, workcenter, station, custkey AS off, {_at_minute(0)} AS ts
    FROM place
  UNION ALL SELECT asset_uuid, path || '-R', area, workcenter, station, custkey + {MAP_STEP}, {_at_minute(3000)}
    FROM place WHERE custkey % 4 = 0
  UNION ALL SELECT asset_uuid, NULL, NULL, NULL, NULL, custkey + {2 * MAP_STEP}, {_at_minute(5000)}
    FROM place WHERE custkey % 9 = 0"""
CTES["linemap"] = f"""
  SELECT asset_uuid, line_id AS uns_id, custkey AS off, {_at_minute(0)} AS ts FROM place
  UNION ALL SELECT asset_uuid, NULL, custkey + {MAP_STEP}, {_at_minute(5000)} FROM place WHERE custkey % 9 = 0"""
CTES["refs"] = """
  SELECT 'SUP-' || CAST(l_suppkey AS STRING) || '-' || CAST(block AS STRING) AS asset_uuid,
    'references_below' AS id, CASE WHEN l_suppkey % 6 = 0 THEN ' ' ELSE
      string_agg('PART-' || CAST(l_partkey AS STRING), ', ' ORDER BY l_partkey) END AS value
  FROM (SELECT DISTINCT l_suppkey, l_partkey, l_partkey // 200 AS block FROM lineitem)
  GROUP BY l_suppkey, block
  UNION ALL
  SELECT asset_uuid, 'references_below',
    CASE WHEN custkey % 2 = 0 THEN asset_uuid || '-AGENT , ' ELSE '' END ||
    CASE WHEN custkey % 3 = 0 THEN asset_uuid || '-PRODUCER, ' ELSE '' END ||
    CASE WHEN custkey % 5 = 0 THEN asset_uuid || '-SUPERVISOR, ' ELSE '' END ||
    'ASSET-' || CAST(custkey + 1 AS STRING) FROM place"""
CTES["edges"] = """
  SELECT asset_uuid AS src, 'below' AS direction, i - 1 AS pos,
    trim(string_split(value, ',')[i]) AS dst
  FROM refs, generate_series(1, len(string_split(value, ','))) g(i) WHERE trim(value) <> ''"""
CTES["ring0"] = f"""
  SELECT c AS cluster, sha256(c || '::' || CAST(r AS STRING)) AS pos
  FROM (VALUES {", ".join(f"('{c}')" for c in CLUSTERS)}) n(c), generate_series(0, 127) g(r)"""
CTES["ring"] = """
  SELECT coalesce(lag(pos) OVER (ORDER BY pos), '0') AS lo, pos AS hi, cluster FROM ring0
  UNION ALL SELECT max(pos), 'g', arg_min(cluster, pos) FROM ring0"""
CTES["owner"] = """
  SELECT a.asset_uuid, r.cluster FROM (SELECT DISTINCT asset_uuid FROM ev) a
  JOIN ring r ON sha256(a.asset_uuid) >= r.lo AND sha256(a.asset_uuid) < r.hi"""
CTES["state"] = """
  SELECT asset_uuid || '|' || id AS key, arg_max(asset_uuid, off) AS asset_uuid,
    arg_max(id, off) AS id, arg_max(value, off) AS value, arg_max(type, off) AS type,
    arg_max(tag, off) AS tag, arg_max(coalesce(attr_ts, 'UNAVAILABLE'), off) AS timestamp
  FROM ev GROUP BY 1"""
CTES["cstate"] = CTES["state"].replace("FROM ev", "FROM ctl")
CTES["types"] = f"""
  SELECT * FROM (SELECT asset_uuid, arg_max(struct_pack(v := nullif(value, 'delete')), off).v AS type
  FROM ctl WHERE id = 'AssetType' AND type = '{V.platform_type}' GROUP BY 1) WHERE type IS NOT NULL"""
CTES["avail"] = """
  SELECT * FROM (SELECT asset_uuid,
    arg_max(struct_pack(v := nullif(value, 'delete')), off).v AS availability
  FROM ctl WHERE id IN ('avail', 'agent_avail') AND value IS NOT NULL GROUP BY 1)
  WHERE availability IS NOT NULL"""
CTES["services"] = f"""
  SELECT asset_uuid, arg_max(value, off) AS docker_service
  FROM ctl WHERE id = 'DockerService' AND type = '{V.platform_type}' GROUP BY 1"""
CTES["curmap"] = """
  SELECT asset_uuid, m.uns_id AS uns_id, m.area AS area, m.workcenter AS workcenter,
    m.station AS station FROM (SELECT asset_uuid, arg_max(struct_pack(uns_id := uns_id,
      area := area, workcenter := workcenter, station := station), off) AS m
    FROM mapc GROUP BY 1)"""
CTES["outcome"] = """
  SELECT 'F-' || CAST(part AS STRING) AS forwarder, cluster, off, ts, num,
    id = 'error' AS is_error, off % 89 = 0 AS is_invalid, off % 19 = 0 AS is_failed,
    off % 100 = part AS opens_call, num / 1000 AS queue_time, num / 2500 AS latency,
    off % 997 AS queue_size, off // 2500 AS epoch
  FROM ev JOIN owner USING (asset_uuid)"""
CTES["counters"] = """
  SELECT forwarder, cluster, ts, epoch,
    sum(CAST(NOT is_error AS INT)) OVER f AS consumed,
    sum(CAST(is_error AS INT)) OVER f AS kafka_errors,
    sum(CAST(NOT is_error AND is_invalid AS INT)) OVER f AS invalid,
    sum(CAST(opens_call AS INT)) OVER f AS consume_calls,
    sum(CAST(NOT is_error AND NOT is_invalid AND NOT is_failed AS INT)) OVER c AS published,
    sum(CAST(NOT is_error AND NOT is_invalid AND is_failed AS INT)) OVER c AS publish_failures
  FROM outcome WINDOW f AS (PARTITION BY forwarder, epoch ORDER BY off),
    c AS (PARTITION BY cluster, epoch ORDER BY off)"""


def with_ctes(sql: str) -> str:
    """Prefix a query with the shared inputs it names, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        keyword = "WITH RECURSIVE " if body[:15].upper() == "WITH RECURSIVE " else "WITH "
        return f"{keyword}{head},\n{body[len(keyword):]}"
    return f"WITH {head}\n{body}"


class Tables:
    """Spark side of the adapters for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark)
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.dir}/{name}.parquet")

    def _adapt(self, name: str, base: DataFrame | None = None) -> DataFrame:
        source, cols = ADAPTERS[name]
        if base is None:
            base = self.places if source == "places" else self.table(source)
        return base.selectExpr(*[f"{_render(e, _SPARK_ISO)} AS {c}" for c, e in cols])

    @staticmethod
    def _events(df: DataFrame) -> DataFrame:
        """Adapter columns as ASSET_EVENT."""
        attrs = F.when(F.col("attr_ts").isNotNull(), F.create_map(F.lit("timestamp"), "attr_ts"))
        return df.select("asset_uuid", "id", "value", "tag", "type", F.coalesce(
            attrs, F.create_map().cast("map<string,string>")).alias("attributes"),
            F.col("part").alias("partition"), F.col("off").alias("offset"),
            F.col("ts").cast("timestamp").alias("log_time"))

    @cached_property
    def places(self) -> DataFrame:
        # nation and region are 25 and 5 rows by definition
        nation = self.table("nation").join(
            F.broadcast(self.table("region")), F.expr("n_regionkey = r_regionkey"))
        return self.table("customer").join(
            F.broadcast(nation), F.expr("c_nationkey = n_nationkey"))

    @property
    def events(self) -> DataFrame:
        return self._events(self._adapt("ev"))

    @property
    def control(self) -> DataFrame:
        return self._events(self._adapt("ctl"))

    def stream(self, name: str) -> DataFrame:
        """An adapter read as a file stream. The pattern names the table, be it one file or a folder
        of part files; a stream refuses the path of a single file."""
        source = ADAPTERS[name][0]
        base = self.spark.readStream.schema(SCHEMAS[source]).parquet(
            f"{self.dir}/{source}.parquet*")
        return self._adapt(name, base)

    def stream_events(self, name: str = "ev") -> DataFrame:
        return self._events(self.stream(name))

    @staticmethod
    def _records(df: DataFrame) -> DataFrame:
        return df.select("key", "value", F.col("part").alias("partition"),
                         F.col("off").alias("offset"),
                         F.col("ts").cast("timestamp").alias("timestamp"),
                         F.col("ts_kind").alias("timestampType"))

    @property
    def records(self) -> DataFrame:
        return self._records(self._adapt("raw"))

    def stream_records(self) -> DataFrame:
        return self._records(self.stream("raw"))

    def adapter(self, name: str) -> DataFrame:
        df = self._adapt(name)
        return df.withColumnRenamed("off", "offset") if "off" in df.columns else df

    @property
    def map_changelog(self) -> DataFrame:
        place = self._adapt("place")
        k = F.col("custkey")
        levels = F.create_map(*[x for n in ("area", "workcenter", "station")
                                for x in (F.lit(n), F.col(n))])
        first = place.select("asset_uuid", F.col("path").alias("uns_id"), levels.alias("uns_levels"),
                             *self._mapped(0, 0))
        moved = place.where(k % 4 == 0).select(
            "asset_uuid", F.concat("path", F.lit("-R")).alias("uns_id"), levels.alias("uns_levels"),
            *self._mapped(1, 3000))
        gone = place.where(k % 9 == 0).select(
            "asset_uuid", F.lit(None).cast("string").alias("uns_id"),
            F.lit(None).cast("map<string,string>").alias("uns_levels"), *self._mapped(2, 5000))
        return first.unionByName(moved).unionByName(gone)

    @staticmethod
    def _mapped(step: int, minute: int) -> list[Column]:
        """Offset in the map's own log and log time of a place's mapping."""
        k = F.col("custkey")
        start = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
        return [(k + step * MAP_STEP).alias("offset"),
                F.timestamp_seconds(start + (k * 10 + minute) * 60).alias("log_time")]

    @property
    def line_map(self) -> DataFrame:
        """Map changelog in which all assets of a production line share one name."""
        place = self._adapt("place")
        k = F.col("custkey")
        first = place.select("asset_uuid", F.col("line_id").alias("uns_id"),
                             *self._mapped(0, 0))
        gone = place.where(k % 9 == 0).select(
            "asset_uuid", F.lit(None).cast("string").alias("uns_id"),
            *self._mapped(1, 5000))
        return first.unionByName(gone)

    @property
    def provided_levels(self) -> DataFrame:
        """Assets with the map of levels they provide (absent levels are not in the map)."""
        df = self._adapt("uin")
        full = F.create_map(*[x for n in LEVELS for x in (F.lit(n), F.col(n))])
        return df.select("asset_uuid", "asset_type", F.col("service").alias("docker_service"),
                         F.map_filter(full, lambda _, v: v.isNotNull()).alias("levels"))

    @property
    def references(self) -> DataFrame:
        """State rows of the reference signals.

        A supplier is one asset per block of 200 parts, so no list holds more than 200 entries
        however many line items one supplier has.
        """
        pairs = self.table("lineitem").select("l_suppkey", "l_partkey").distinct().withColumn(
            "block", F.expr("l_partkey div 200"))
        ordered = F.transform(F.sort_array(F.collect_list("l_partkey")),
                              lambda p: F.concat(F.lit("PART-"), p.cast("string")))
        sup = pairs.groupBy("l_suppkey", "block").agg(
            F.array_join(ordered, ", ").alias("list")).select(
            F.concat_ws("-", F.lit("SUP"), F.col("l_suppkey").cast("string"),
                        F.col("block").cast("string")).alias("asset_uuid"),
            F.when(F.col("l_suppkey") % 6 == 0, " ").otherwise(F.col("list")).alias("value"))
        dev = self._adapt("place").select("asset_uuid", F.expr(
            "CASE WHEN custkey % 2 = 0 THEN asset_uuid || '-AGENT , ' ELSE '' END || "
            "CASE WHEN custkey % 3 = 0 THEN asset_uuid || '-PRODUCER, ' ELSE '' END || "
            "CASE WHEN custkey % 5 = 0 THEN asset_uuid || '-SUPERVISOR, ' ELSE '' END || "
            "'ASSET-' || CAST(custkey + 1 AS STRING)").alias("value"))
        return sup.unionByName(dev).select(
            F.concat("asset_uuid", F.lit("|references_below")).alias("key"), "asset_uuid",
            F.lit("references_below").alias("id"), "value",
            F.lit(V.platform_type).alias("type"), F.lit("AssetsReferences").alias("tag"),
            F.lit("UNAVAILABLE").alias("timestamp"))

    def outcomes(self, routed: bool = False) -> DataFrame:
        """One delivery outcome per message, with its cluster on request."""
        off = F.col("off")
        rows = self._adapt("ev")
        rows = route(rows, CLUSTERS) if routed else rows
        return rows.select(
            F.concat(F.lit("F-"), F.col("part").cast("string")).alias("forwarder"), "asset_uuid",
            *(["cluster"] if routed else []), off.alias("offset"), F.col("ts").cast("timestamp").alias("ts"),
            (F.col("id") == "error").alias("is_error"), (off % 89 == 0).alias("is_invalid"),
            (off % 19 == 0).alias("is_failed"), (off % 100 == F.col("part")).alias("opens_call"),
            (F.col("num") / 1000).alias("queue_time"), (F.col("num") / 2500).alias("latency"),
            (off % 997).alias("queue_size"), F.expr("off div 2500").alias("epoch"))

    def counters(self, label: str, counted: dict[str, str]) -> DataFrame:
        """Running counters per label as samples; every 2500 messages they restart, so a window
        group never exceeds one epoch."""
        w = Window.partitionBy(label, "epoch").orderBy("offset").rowsBetween(
            Window.unboundedPreceding, 0)
        return self.outcomes(label == "cluster").select(label, "ts", *[
            F.sum(F.expr(e)).over(w).alias(n) for n, e in counted.items()])

    def topology(self, events: DataFrame | None = None, removals: DataFrame | None = None,
                 map_changelog: DataFrame | None = None) -> Catalog:
        apps = self.adapter("app")
        configs = self.adapter("cfg").select(
            F.col("asset_uuid").alias("k"), F.struct("connector_config").alias("v"), "offset")
        targets = apps.select(F.col("uuid").alias("k"), F.struct(
            F.lower("uuid").alias("host"), "port", "path").alias("v"), "offset")
        return build_topology(self.spark, self.events if events is None else events,
                              self.map_changelog if map_changelog is None else map_changelog,
                              source="events", connector_changelog=configs,
                              metrics_changelog=targets, removals=removals)
