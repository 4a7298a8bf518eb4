"""Names, routing and delivery metrics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from plantlog import schema as S
from plantlog.functions import iso_ms
from plantlog.operators import events as E, metrics as M, routing, state as St, uns
from plantlog.operators.views import asset_attributes
from workload.adapters import CLUSTERS, LEVELS, NAMESPACE, SEGMENTS, Tables
from workload.q_state import VALID, requests, state
from workload.registry import query

# ---- Names -------------------------------------------------------------------------------

_ASOF = """SELECT m.uns_id, e.asset_uuid, e.id, e.value, e.off FROM ev e ASOF LEFT JOIN mapc m
  ON e.asset_uuid = m.asset_uuid AND e.ts >= m.ts WHERE m.uns_id IS NOT NULL"""


def _by_uns(t: Tables, **kw):
    return uns.stream_by_uns(t.events, t.map_changelog, **kw).select(
        "uns_id", "asset_uuid", "id", "value", F.col("offset").alias("off"))


@query("stream_by_uns", _ASOF)
def _(t: Tables):
    return _by_uns(t)


@query("stream_by_uns_bucketed", _ASOF)
def _(t: Tables):
    return _by_uns(t, strategy="bucketed", bucket_width=6 * 3600 * 1_000_000)


@query("state_by_uns", """
SELECT m.uns_id || '|' || s.id AS key, s.key AS asset_uuid_key, m.uns_id, s.asset_uuid, s.id, s.value,
  s.type, s.tag, s.timestamp FROM state s JOIN curmap m USING (asset_uuid) WHERE m.uns_id IS NOT NULL""")
def _(t: Tables):
    return uns.state_by_uns(state(t), St.uns_map(t.map_changelog))


@query("asset_attributes_by_uns", """
SELECT m.uns_id, s.id, s.value, CASE WHEN s.type = 'Samples' THEN TRY_CAST(s.value AS DOUBLE) END AS value_num
FROM state s JOIN curmap m USING (asset_uuid) WHERE m.uns_id IS NOT NULL AND s.type <> 'Method'""")
def _(t: Tables):
    named = uns.state_by_uns(state(t), St.uns_map(t.map_changelog))
    return asset_attributes(named, key="uns_id").select("uns_id", "id", "value", "value_num")


@query("consume_by_uns", """
SELECT id, value, off FROM (""" + _ASOF + """) WHERE uns_id = (SELECT path FROM place WHERE custkey = 8)""")
def _(t: Tables):
    place = t.adapter("place").where("custkey = 8").select(F.col("path").alias("uns_id"))
    mine = E.for_consumer(_by_uns(t), transform=lambda df: df.join(place, "uns_id", "left_semi"))
    return mine.select("id", "value", "off")


@query("filter_mapped", """
SELECT s.key, m.uns_id FROM state s LEFT JOIN curmap m USING (asset_uuid) WHERE m.uns_id IS NOT NULL""")
def _(t: Tables):
    joined = state(t).join(St.uns_map(t.map_changelog), "asset_uuid", "left")
    return joined.where(F.col("uns_id").isNotNull()).select("key", "uns_id")


@query("resolve_uns_id", """
WITH cur AS (SELECT asset_uuid, arg_max(struct_pack(u := uns_id), off).u AS uns_id,
  arg_max(ts, off) AS ts FROM linemap GROUP BY 1),
o AS (SELECT uns_id, arg_max(asset_uuid, ts) AS asset_uuid, count(*) AS claims FROM cur
  WHERE uns_id IS NOT NULL GROUP BY 1),
asked AS (SELECT DISTINCT line_id AS uns_id FROM place UNION ALL SELECT DISTINCT 'Mars/' || area FROM place)
SELECT uns_id, asset_uuid, coalesce(claims, 0) AS claims FROM asked LEFT JOIN o USING (uns_id)""")
def _(t: Tables):
    place = t.adapter("place")
    asked = place.select(F.col("line_id").alias("uns_id")).distinct().unionByName(
        place.select(F.concat(F.lit("Mars/"), "area").alias("uns_id")).distinct())
    return uns.resolve_uns(asked, t.line_map)


@query("uns_remap_changes", """
WITH iv AS (SELECT uns_id, asset_uuid, epoch_us(ts) AS lo, coalesce(lead(epoch_us(ts)) OVER (
    PARTITION BY asset_uuid ORDER BY ts), 9223372036854775807) AS hi FROM linemap),
  held AS (SELECT * FROM iv WHERE uns_id IS NOT NULL),
  points AS (SELECT uns_id, lo AS micros FROM held UNION SELECT uns_id, hi FROM held
         WHERE hi < 9223372036854775807),
  own AS (SELECT p.uns_id, p.micros, arg_max(asset_uuid, (lo, asset_uuid)) AS asset_uuid
    FROM points p LEFT JOIN held ON held.uns_id = p.uns_id AND lo <= p.micros AND p.micros < hi GROUP BY 1, 2)
SELECT uns_id, asset_uuid, micros, previous_asset FROM (SELECT *, lag(asset_uuid IGNORE NULLS) OVER (
  PARTITION BY uns_id ORDER BY micros) AS previous_asset FROM own)
WHERE asset_uuid <> previous_asset""")
def _(t: Tables):
    return uns.remap_changes(t.line_map).select(
        "uns_id", "asset_uuid", F.unix_micros("log_time").alias("micros"), "previous_asset")


_SEG = ", ".join(f"'{s}'" for s in SEGMENTS)


@query("uns_extract", """
SELECT asset_uuid, 'Plant' AS inc, area, workcenter, station, coalesce(asset, asset_uuid) AS asset FROM uin""")
def _(t: Tables):
    levels = uns.resolved_levels(NAMESPACE)
    return t.provided_levels.withColumn("l", levels).select(
        "asset_uuid", *[F.col("l")[n].alias(n) for n in LEVELS])


@query("uns_constant_violation", "SELECT asset_uuid, CASE WHEN inc <> 'Plant' THEN 'inc' END AS level FROM uin")
def _(t: Tables):
    return t.provided_levels.select("asset_uuid", uns.constant_violation(NAMESPACE).alias("level"))


@query("uns_prefix_violation", """
SELECT asset_uuid, CASE WHEN workcenter IS NULL AND station IS NOT NULL THEN 'gap' END AS problem FROM uin""")
def _(t: Tables):
    return t.provided_levels.select("asset_uuid", uns.prefix_violation(NAMESPACE).alias("problem"))


@query("uns_enum_violation", f"""
SELECT asset_uuid, CASE WHEN station NOT IN ({_SEG}) THEN 'station' END AS level FROM uin""")
def _(t: Tables):
    return t.provided_levels.select("asset_uuid", uns.enum_violation(NAMESPACE).alias("level"))


@query("uns_path", """
SELECT asset_uuid, concat_ws('/', 'Plant', area, workcenter, station, coalesce(asset, asset_uuid)) AS path
FROM uin""")
def _(t: Tables):
    return t.provided_levels.select("asset_uuid", uns.uns_path(NAMESPACE).alias("path"))


@query("attach_uns", f"""
SELECT u.asset_uuid, CASE WHEN inc <> 'Plant' THEN 'constant:inc'
  WHEN u.workcenter IS NULL AND u.station IS NOT NULL THEN 'gap'
  WHEN u.station NOT IN ({_SEG}) THEN 'enum:station' END AS error, v.uns_id, v.asset
FROM uin u LEFT JOIN ({VALID}) v USING (asset_uuid)""")
def _(t: Tables):
    return requests(t).select("asset_uuid", "error", "uns_id",
                              F.col("uns_levels")["asset"].alias("asset"))


@query("duplicate_uuid", """
SELECT uuid, count(*) AS claims, string_agg(name, ',' ORDER BY name) AS names FROM (
  SELECT p_brand || p_type AS uuid, p_name || CAST(p_partkey AS VARCHAR) AS name FROM part)
GROUP BY 1 HAVING count(*) > 1""")
def _(t: Tables):
    return uns.duplicate_uuids(t.table("part").select(
        F.concat("p_brand", "p_type").alias("uuid"),
        F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"))).withColumn(
        "names", F.array_join("names", ","))


@query("uns_rollup", """
SELECT area, workcenter, station, CAST(sum(signals) AS BIGINT) AS signals, count(*) AS assets FROM (
  SELECT asset_uuid, count(*) AS signals FROM state GROUP BY 1) JOIN curmap m USING (asset_uuid)
WHERE m.uns_id IS NOT NULL GROUP BY ROLLUP (area, workcenter, station)""")
def _(t: Tables):
    return uns.uns_rollup(state(t), St.uns_map(t.map_changelog), ["area", "workcenter", "station"])


# ---- Routing -----------------------------------------------------------------------------

@query("route_assets", "SELECT asset_uuid, cluster FROM owner")
def _(t: Tables):
    return routing.route(t.events.select("asset_uuid").distinct(), CLUSTERS)


@query("routing_balance", """
SELECT cluster, count(DISTINCT asset_uuid) AS assets, count(*) AS messages
FROM ev JOIN owner USING (asset_uuid) GROUP BY 1""")
def _(t: Tables):
    return routing.routing_balance(t.events, CLUSTERS)


@query("ring_reassignment", """
WITH r0 AS (SELECT c AS cluster, sha256(c || '::' || CAST(r AS VARCHAR)) AS pos
  FROM (VALUES ('C1'), ('C2'), ('C3'), ('C4')) n(c), generate_series(0, 127) g(r)),
r4 AS (SELECT coalesce(lag(pos) OVER (ORDER BY pos), '0') AS lo, pos AS hi, cluster FROM r0
  UNION ALL SELECT max(pos), 'g', arg_min(cluster, pos) FROM r0)
SELECT o.asset_uuid, o.cluster AS old_cluster, r4.cluster AS new_cluster FROM owner o
JOIN r4 ON sha256(o.asset_uuid) >= r4.lo AND sha256(o.asset_uuid) < r4.hi WHERE o.cluster <> r4.cluster""")
def _(t: Tables):
    return routing.ring_reassignment(t.events.select("asset_uuid").distinct(), CLUSTERS,
                                     [*CLUSTERS, "C4"])


# ---- Counters and rates ------------------------------------------------------------------

@query("delivery_counters", """
SELECT forwarder AS label, count(*) FILTER (NOT is_error) AS a, count(*) FILTER (is_error) AS b,
  count(*) FILTER (NOT is_error AND is_invalid) AS c, count(*) FILTER (opens_call) AS d
FROM outcome GROUP BY 1
UNION ALL SELECT cluster, count(*) FILTER (NOT is_failed), count(*) FILTER (is_failed), 0, 0
FROM outcome WHERE NOT is_error AND NOT is_invalid GROUP BY 1""")
def _(t: Tables):
    per_asset = M.asset_counters(t.outcomes())
    f = M.forwarder_counters(per_asset).select(
        F.col("forwarder").alias("label"), F.col("consumed").alias("a"),
        F.col("kafka_errors").alias("b"), F.col("invalid").alias("c"),
        F.col("consume_calls").alias("d"))
    zero = F.lit(0).cast("bigint")
    c = M.cluster_counters(per_asset, CLUSTERS).select(
        F.col("cluster").alias("label"), F.col("published").alias("a"),
        F.col("publish_failures").alias("b"), zero.alias("c"), zero.alias("d"))
    return f.unionByName(c)


_COUNTED = {
    "consumed": "CAST(NOT is_error AS INT)",
    "kafka_errors": "CAST(is_error AS INT)",
    "invalid": "CAST(NOT is_error AND is_invalid AS INT)",
    "consume_calls": "CAST(opens_call AS INT)",
    "published": "CAST(NOT is_error AND NOT is_invalid AND NOT is_failed AS INT)",
    "publish_failures": "CAST(NOT is_error AND NOT is_invalid AND is_failed AS INT)",
}
_RATES = {"rate_messages_read": ("forwarder", "consumed"),
          "rate_consume_calls": ("forwarder", "consume_calls"),
          "rate_published": ("cluster", "published"),
          "rate_kafka_errors": ("forwarder", "kafka_errors"),
          "rate_invalid": ("forwarder", "invalid"),
          "rate_publish_failures": ("cluster", "publish_failures")}


def _window_text():
    return iso_ms(F.col("window_start")).alias("window_start")


def _rate(name: str, label: str, counter: str) -> None:
    sql = f"""
SELECT {label}, strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS window_start,
  round(CAST(sum(CASE WHEN prev IS NULL THEN 0 WHEN v < prev THEN v ELSE v - prev END) AS DOUBLE) / 60, 9)
    AS rate
FROM (SELECT {label}, ts, {counter} AS v, lag({counter}) OVER (PARTITION BY {label} ORDER BY ts) AS prev
  FROM counters) GROUP BY ALL"""

    @query(name, sql)
    def _(t: Tables):
        samples = t.counters(label, {"value": _COUNTED[counter]})
        return M.counter_rate(samples, [label]).select(
            label, _window_text(), F.round("rate", 9).alias("rate"))


for _name, (_label, _counter) in _RATES.items():
    _rate(_name, _label, _counter)


# ---- Histograms and quantiles ------------------------------------------------------------

_HISTS = {"queue_size": ("queue_size", S.QUEUE_SIZE_BOUNDS),
          "queue_time": ("queue_time", S.QUEUE_TIME_BOUNDS),
          "worker_latency": ("latency", S.LATENCY_BOUNDS)}


def _bounds_sql(bounds) -> str:
    return "[" + ", ".join(f"{float(b)!r}" for b in bounds) + ", 'infinity'::DOUBLE]"


def _histogram(name: str, value: str, bounds) -> None:
    sql = f"""
SELECT forwarder, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(round(le * 10000) AS BIGINT)::VARCHAR END AS le,
  count(*) FILTER (WHERE {value} <= le) AS value, round(CAST(sum({value}) AS DOUBLE), 6) AS sum
FROM outcome, (SELECT unnest({_bounds_sql(bounds)}) AS le) GROUP BY ALL"""

    @query(name, sql)
    def _(t: Tables):
        h = M.histogram(t.outcomes(), value, bounds, ["forwarder"])
        le = F.when(F.col("le") == M.INFINITY, "+Inf").otherwise(
            F.round(F.col("le") * 10000).cast("bigint").cast("string"))
        return h.select("forwarder", le.alias("le"), "value",
                        F.round(F.col("sum").cast("double"), 6).alias("sum"))


_histogram("queue_time_histogram", "queue_time", S.QUEUE_TIME_BOUNDS)
_histogram("latency_histogram", "latency", S.LATENCY_BOUNDS)
_histogram("queue_size_histogram", "queue_size", S.QUEUE_SIZE_BOUNDS)


def _bucket_samples(t: Tables, value: str, bounds):
    """Bucket counters as scraped every minute; they restart every day."""
    by_minute = t.outcomes().withColumn("minute", F.date_trunc("minute", "ts"))
    h = M.histogram_columns(by_minute, value, bounds, ["forwarder", "minute"])
    day = Window.partitionBy("forwarder", F.to_date("minute")).orderBy("minute").rowsBetween(
        Window.unboundedPreceding, 0)
    return h.select("forwarder", F.col("minute").alias("ts"),
                    *[F.sum(n).over(day).alias(n) for n in M.bucket_names(bounds)])


def _quantile_sql(value: str, bounds, q: float) -> str:
    return f"""
WITH h AS (SELECT forwarder, date_trunc('minute', ts) AS m, le,
    count(*) FILTER (WHERE {value} <= le) AS n
  FROM outcome, (SELECT unnest({_bounds_sql(bounds)}) AS le) GROUP BY ALL),
s AS (SELECT forwarder, m, le, sum(n) OVER (PARTITION BY forwarder, le, CAST(m AS DATE) ORDER BY m) AS v
  FROM h),
l AS (SELECT *, lag(v) OVER (PARTITION BY forwarder, le ORDER BY m) AS prev FROM s),
r AS (SELECT forwarder, m, le, CAST(CASE WHEN prev IS NULL THEN 0 WHEN v < prev THEN v ELSE v - prev END
  AS DOUBLE) / 60 AS c FROM l),
k AS (SELECT *, max(c) OVER (PARTITION BY forwarder, m) * {q} AS rank,
  coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS lo_c, row_number() OVER w AS i
  FROM r WINDOW w AS (PARTITION BY forwarder, m ORDER BY le))
SELECT forwarder, strftime(m, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS window_start,
  round(arg_min(CASE WHEN isinf(le) THEN lo WHEN i = 1 AND le <= 0 THEN le
    ELSE lo + (le - lo) * (rank - lo_c) / (c - lo_c) END, le)
    FILTER (WHERE c >= rank AND rank > 0), 9) AS quantile
FROM k GROUP BY ALL"""


def _quantile(name: str, value: str, bounds, q: float) -> None:
    @query(name, _quantile_sql(value, bounds, q))
    def _(t: Tables):
        samples = _bucket_samples(t, value, bounds)
        return M.windowed_quantile_columns(samples, q, ["forwarder"], bounds).select(
            "forwarder", _window_text(), F.round("quantile", 9).alias("quantile"))


def _average(name: str, value: str) -> None:
    sql = f"""
WITH s AS (SELECT forwarder, ts, sum({value}) OVER w AS s, count(*) OVER w AS c FROM outcome
  WINDOW w AS (PARTITION BY forwarder, epoch ORDER BY off)),
l AS (SELECT *, lag(s) OVER w AS ps, lag(c) OVER w AS pc FROM s
  WINDOW w AS (PARTITION BY forwarder ORDER BY ts))
SELECT forwarder, strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS window_start,
  round(sum(CASE WHEN ps IS NULL THEN 0 WHEN s < ps THEN s ELSE s - ps END) /
    nullif(sum(CASE WHEN pc IS NULL THEN 0 WHEN c < pc THEN c ELSE c - pc END), 0), 7) AS avg
FROM l GROUP BY ALL"""

    @query(name, sql)
    def _(t: Tables):
        samples = t.counters("forwarder", {"sum": value, "count": "1"})
        return M.ratio_of_rates(samples, ["forwarder"]).select(
            "forwarder", _window_text(), F.round("avg", 7).alias("avg"))


for _name, (_value, _bounds) in _HISTS.items():
    _average(f"{_name}_avg", _value)
    _quantile(f"{_name}_p95", _value, _bounds, 0.95)
    _quantile(f"{_name}_p99", _value, _bounds, 0.99)


@query("queue_size_current", "SELECT forwarder, arg_max(queue_size, ts) AS queue_size FROM outcome GROUP BY 1")
def _(t: Tables):
    return M.gauge_current(t.outcomes(), "forwarder", "queue_size")


@query("build_info", """
SELECT forwarder, arg_max('v' || CAST(epoch AS VARCHAR), ts) AS version,
  arg_max('n' || CAST(off % 3 AS VARCHAR), ts) AS node, 'fan_out_layer' AS component, 'forwarder' AS role
FROM outcome GROUP BY 1""")
def _(t: Tables):
    s = t.outcomes().select("forwarder", "ts",
                          F.concat(F.lit("v"), F.col("epoch").cast("string")).alias("version"),
                          F.concat(F.lit("n"), (F.col("offset") % 3).cast("string")).alias("node"))
    return M.latest_labels(s, "forwarder", ["version", "node"],
                           {"component": "fan_out_layer", "role": "forwarder"})


def _latencies(t: Tables, *also: str):
    late = F.timestamp_millis(F.unix_millis("log_time") + F.col("offset") % 50)
    sent = F.timestamp_millis(F.unix_millis("log_time") + F.col("offset") % 20)
    msgs = t.events.withColumn("log_time_type", F.lit(0)).withColumn("log_time", late)
    return M.stage_latencies(E.delivery_timestamps(msgs, sent), *also)


# Sketches per asset and hour, rolled up per asset: the value at rank 0.95 lies within 0.02 of that rank.
@query("delivery_latency_sketch", """
SELECT asset_uuid, count(*) AS n, true AS within FROM ev GROUP BY 1""")
def _(t: Tables):
    value = F.col("log_to_forwarder_ms")
    lat = _latencies(t, "log_time")
    hourly = M.latency_sketches(lat.withColumn("hour", F.date_trunc("hour", "log_time")), "log_to_forwarder_ms",
                                ["asset_uuid", "hour"])
    p95 = M.sketch_quantiles(M.merge_sketches(hourly, ["asset_uuid"]), {"p95": 0.95})
    return lat.join(p95, "asset_uuid").groupBy("asset_uuid", "n").agg(
        F.avg((value < F.col("p95")).cast("int")).alias("below"), F.avg((value <= F.col("p95")).cast("int")).alias("upto")
    ).select("asset_uuid", "n", ((F.col("below") <= 0.97) & (F.col("upto") >= 0.93)).alias("within"))


@query("delivery_latency", """
SELECT asset_uuid, count(a) AS n, round(avg(a), 6) AS source_to_log_avg, max(a) AS source_to_log_max,
  round(avg(b), 6) AS log_to_forwarder_avg, round(quantile_cont(b, 0.95), 6) AS log_to_forwarder_p95
FROM (SELECT asset_uuid, CASE WHEN attr_ts IS NOT NULL THEN epoch_ms(ts + to_milliseconds(off % 50))
  - epoch_ms(ts) END AS a, off % 20 AS b FROM ev) GROUP BY 1""")
def _(t: Tables):
    return _latencies(t).groupBy("asset_uuid").agg(
        F.count("source_to_log_ms").alias("n"),
        F.round(F.avg("source_to_log_ms"), 6).alias("source_to_log_avg"),
        F.max("source_to_log_ms").alias("source_to_log_max"),
        F.round(F.avg("log_to_forwarder_ms"), 6).alias("log_to_forwarder_avg"),
        F.round(F.percentile("log_to_forwarder_ms", F.lit(0.95)), 6).alias("log_to_forwarder_p95"))
