"""Connector-configuration documents as tables: signals, inheritance, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantlog import schema as S
from plantlog.functions import broadcast_if_bounded

_NODE = ("struct<node_id:string,browse_path:string,tag:string,access_level:string,"
         "queue_size:int,sampling_interval:double,deadband:double>")
CONFIG_DDL = (
    "struct<type:string,"
    "server:struct<uri:string,subscription:struct<publishing_interval:double,queue_size:int,"
    "sampling_interval:double>>,"
    f"constants:map<string,{_NODE}>,variables:map<string,{_NODE}>,"
    f"events:map<string,{_NODE}>,methods:map<string,{_NODE}>,"
    "host:string,port:int,data:map<string,struct<tag:string,type:string>>,"
    "agent:struct<ip:string,port:int,device_xml:string,"
    "adapter:struct<ip:string,image:string,port:int>>>")
SECTIONS = ("constants", "variables", "events", "methods")


def parse_configs(configs: DataFrame) -> DataFrame:
    """Add ``cfg`` to ``(asset_uuid, connector_config)``; a full device document holds the
    configuration under ``connector``."""
    text = F.coalesce(F.get_json_object("connector_config", "$.connector"),
                      F.col("connector_config"))
    return configs.withColumn("cfg", F.from_json(text, CONFIG_DDL))


def connector_signals(parsed: DataFrame) -> DataFrame:
    """One row per declared signal: OPC UA nodes of every section, or SHDR data points."""
    def node(section: str) -> Column:
        entries = F.map_entries(F.col(f"cfg.{section}"))
        return F.coalesce(F.transform(entries, lambda e: F.struct(
            F.lit(section).alias("section"), e["key"].alias("name"), e["value"]["tag"].alias("tag"),
            F.lit(None).cast("string").alias("type"), e["value"]["node_id"].alias("node_id"),
            e["value"]["browse_path"].alias("browse_path"),
            e["value"]["queue_size"].alias("queue_size"),
            e["value"]["sampling_interval"].alias("sampling_interval"),
            F.coalesce(e["value"]["deadband"], F.lit(0.0)).alias("deadband"),
            F.coalesce(e["value"]["access_level"], F.lit("ro")).alias("access_level"))), F.array())

    def point() -> Column:
        entries = F.map_entries(F.col("cfg.data"))
        none = F.lit(None)
        return F.coalesce(F.transform(entries, lambda e: F.struct(
            F.lit("data").alias("section"), e["key"].alias("name"), e["value"]["tag"].alias("tag"),
            e["value"]["type"].alias("type"), none.cast("string").alias("node_id"),
            none.cast("string").alias("browse_path"), none.cast("int").alias("queue_size"),
            none.cast("double").alias("sampling_interval"), F.lit(0.0).alias("deadband"),
            none.cast("string").alias("access_level"))), F.array())

    everything = F.when(F.col("cfg.type") == "opcua", F.concat(*[node(s) for s in SECTIONS])).when(
        F.col("cfg.type") == "shdr", point())
    return parsed.select(
        "asset_uuid", F.col("cfg.type").alias("connector"),
        F.col("cfg.server.subscription").alias("server"),
        F.explode(everything).alias("s")).select("asset_uuid", "connector", "server", "s.*")


def with_subscription(signals: DataFrame) -> DataFrame:
    """Variables with the subscription in force: their own, the server's, or the default."""
    return signals.where(F.col("section") == "variables").select(
        "asset_uuid", "name", "tag", "deadband", "access_level",
        F.coalesce("queue_size", "server.queue_size", F.lit(S.QUEUE_SIZE)).alias("queue_size"),
        F.coalesce("sampling_interval", "server.sampling_interval",
                   F.lit(S.SAMPLING_INTERVAL)).alias("sampling_interval"))


def parse_node_ids(signals: DataFrame) -> DataFrame:
    """Split ``ns=<n>;(i|s)=<identifier>``; ``valid`` is false when the text has another form.

    The identifier ends at a further semicolon being refused, as the form has exactly two parts.
    """
    text = F.col("node_id")
    valid = text.rlike(S.NODE_ID_PATTERN) & (F.size(F.split(text, ";")) == 2)
    parts = r"^ns=(\d+);([is])=(.+)$"
    return signals.where(text.isNotNull()).select(
        "asset_uuid", "section", "name", "node_id", valid.alias("valid"),
        F.when(valid, F.regexp_extract(text, parts, 1).try_cast("int")).alias("namespace_index"),
        F.when(valid, F.regexp_extract(text, parts, 2)).alias("identifier_type"),
        F.when(valid, F.regexp_extract(text, parts, 3)).alias("identifier"))


def browse_path_error(path: Column) -> Column:
    """First broken rule of a browse path (segment order, then rule order), NULL when sound."""
    def segment_error(seg: Column) -> Column:
        index = F.regexp_extract(seg, "^([^:]*):", 1)
        ident = F.regexp_extract(seg, "(?s)^[^:]*:(.*)$", 1)
        return (F.when(~seg.contains(":"), "no_colon")
                .when(seg != F.trim(seg), "outer_space")
                .when((index != F.trim(index)) | (ident != F.trim(ident)), "space_at_colon")
                .when(~index.rlike(r"^\d+$"), "index_not_numeric")
                .when(ident == "", "empty_identifier"))

    segments = F.split(path, "/")
    errors = F.array_compact(F.transform(segments, segment_error))
    return (F.when(F.coalesce(path, F.lit("")) == "", F.lit(None).cast("string"))
            .when(F.element_at(segments, 1) != S.BROWSE_ROOT, "not_from_root")
            .otherwise(F.try_element_at(errors, F.lit(1))))


def browse_path_checks(signals: DataFrame) -> DataFrame:
    return signals.where(F.col("browse_path").isNotNull()).select(
        "asset_uuid", "section", "name", "browse_path",
        browse_path_error(F.col("browse_path")).alias("error"))


def node_address_checks(signals: DataFrame) -> DataFrame:
    """Exactly one of ``node_id`` and ``browse_path`` per OPC UA signal."""
    has_id = F.coalesce(F.col("node_id") != "", F.lit(False))
    has_path = F.coalesce(F.col("browse_path") != "", F.lit(False))
    return signals.where(F.col("connector") == "opcua").select(
        "asset_uuid", "section", "name",
        F.when(~has_id & ~has_path, "neither").when(has_id & has_path, "both").alias("error"))


def duplicate_nodes(signals: DataFrame) -> DataFrame:
    """Nodes declared more than once within a section of one device, with the names that use them."""
    node = F.coalesce("node_id", "browse_path")
    return (signals.where(F.col("connector") == "opcua").withColumn("node", node)
            .where(F.col("node").isNotNull()).groupBy("asset_uuid", "section", "node")
            .agg(F.count("*").alias("uses"), F.sort_array(F.collect_list("name")).alias("names"))
            .where(F.col("uses") > 1))


def name_conflicts(signals: DataFrame) -> DataFrame:
    """Local names used in more than one section of one device."""
    flags = [F.bool_or(F.col("section") == s) for s in SECTIONS]
    used = F.array_compact(F.array(*[F.when(f, F.lit(s)) for f, s in zip(flags, SECTIONS)]))
    return (signals.where(F.col("connector") == "opcua").groupBy("asset_uuid", "name")
            .agg(F.array_join(used, ",").alias("sections"), F.size(used).alias("n"))
            .where(F.col("n") > 1))


def mtconnect_checks(parsed: DataFrame) -> DataFrame:
    """Agent and adapter source rules of MTConnect configurations."""
    a = F.col("cfg.agent")
    ad = a["adapter"]
    external = a["ip"].isNotNull()
    filled = F.coalesce(a["device_xml"] != "", F.lit(False))
    agent_error = (
        F.when(~external & a["device_xml"].isNull(), "device_xml_missing")
        .when(~external & ad.isNull(), "adapter_missing")
        .when(external & ad.isNotNull(), "adapter_not_allowed")
        .when(external & filled, "device_xml_not_allowed"))
    both = F.coalesce((ad["ip"] != "") & (ad["image"] != ""), F.lit(False))
    neither = ad["ip"].isNull() & ad["image"].isNull()
    adapter_error = F.when(ad.isNotNull() & (both | neither), "ip_xor_image")
    return parsed.where(F.col("cfg.type") == "mtconnect").select(
        "asset_uuid", agent_error.alias("agent_error"), adapter_error.alias("adapter_error"))


def shdr_checks(parsed: DataFrame) -> DataFrame:
    """SHDR port range and the number of data points of an unknown type."""
    bad = F.filter(F.map_values("cfg.data"),
                   lambda p: ~F.coalesce(p["type"].isin(S.SAMPLES, S.EVENTS), F.lit(False)))
    return parsed.where(F.col("cfg.type") == "shdr").select(
        "asset_uuid", F.col("cfg.port").alias("port"),
        F.coalesce(F.col("cfg.port").between(1, 65535), F.lit(False)).alias("port_ok"),
        F.coalesce(F.size(bad), F.lit(0)).alias("bad_types"))


def label_readings(events: DataFrame, signals: DataFrame) -> DataFrame:
    """Readings with the tag and type their device's connector declares (undeclared keep NULL)."""
    declared = signals.select("asset_uuid", F.col("name").alias("id"),
                              F.col("tag").alias("declared_tag"),
                              F.col("type").alias("declared_type"))
    return events.join(broadcast_if_bounded(declared), ["asset_uuid", "id"], "left")
