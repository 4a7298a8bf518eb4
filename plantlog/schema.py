"""Declared schemas and fixed values of the asset-event model.

Sources never infer a schema: every reader passes one of the StructTypes below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

STRING = T.StringType()
STRING_MAP = T.MapType(STRING, STRING)

ASSET_EVENT = T.StructType([
    T.StructField("asset_uuid", STRING),
    T.StructField("id", STRING),
    T.StructField("value", STRING),
    T.StructField("tag", STRING),
    T.StructField("type", STRING),
    T.StructField("attributes", STRING_MAP),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("log_time", T.TimestampType()),
])

# Columns of one log record before its JSON value is parsed (Kafka's own layout).
RAW_RECORD = T.StructType([
    T.StructField("key", STRING),
    T.StructField("value", STRING),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("timestampType", T.IntegerType()),
])

UNS_MAP = T.StructType([
    T.StructField("asset_uuid", STRING),
    T.StructField("uns_id", STRING),
    T.StructField("uns_levels", STRING_MAP),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("offset", T.LongType()),
    T.StructField("log_time", T.TimestampType()),
])

METHOD_CONTRACT = T.StructType([
    T.StructField("description", STRING),
    T.StructField("arguments", T.ArrayType(T.StructType([
        T.StructField("name", STRING),
        T.StructField("description", STRING),
    ]))),
])

COMMAND_ENVELOPE = T.StructType([
    T.StructField("header", T.StructType([
        T.StructField("correlation_id", STRING),
        T.StructField("sender_uuid", STRING),
        T.StructField("timestamp", STRING),
        T.StructField("signature", STRING),
    ])),
    T.StructField("arguments", STRING_MAP),
])

STATE_COLUMNS = ("asset_uuid", "id", "value", "type", "tag", "timestamp")

# ---- Fixed values: literals that producers and consumers of the log agree on ----

UNAVAILABLE = "UNAVAILABLE"
AVAILABLE = "AVAILABLE"
DELETE = "delete"
KEY_SEPARATOR = "|"

SAMPLES = "Samples"
EVENTS = "Events"
CONDITION = "Condition"
METHOD = "Method"

ASSET_TYPE_ID = "AssetType"
SERVICE_ID = "DockerService"
AVAILABILITY_IDS = ("avail", "agent_avail")
REFERENCE_IDS = ("references_below", "references_above")
REFERENCES_TAG = "AssetsReferences"
UNS_LEVEL_TAG = "UNSLevel"
UNS_ID_TAG = "UNSId"
COMMAND_SUFFIX = "_CMD"
COMMAND_TAG = "Method.Command"
DEVICE_ROLES = ("AGENT", "PRODUCER", "SUPERVISOR")
NOT_DEPLOYED = "NOT DEPLOYED"
NO_ARGUMENTS = "—"
METRICS_PATH = "/metrics"

MTCONNECT_AGENT = "MTConnectAgent"

# Upper bounds of the delivery histograms (seconds, seconds, messages); +Inf closes each.
QUEUE_TIME_BOUNDS = (0.0001, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5)
LATENCY_BOUNDS = (0.0001, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25)
QUEUE_SIZE_BOUNDS = (0, 1, 2, 5, 10, 20, 50, 100, 500, 1000, 2500, 5000, 10000)

NODE_ID_PATTERN = r"^ns=\d+;(i|s)=.+$"
BROWSE_ROOT = "0:Root"

# Server-level subscription defaults of a connector (ms, messages, ms).
PUBLISHING_INTERVAL = 100.0
QUEUE_SIZE = 1
SAMPLING_INTERVAL = 0.0

RING_REPLICAS = 128
# ---- end of fixed values ----


@dataclass(frozen=True)
class Vocabulary:
    """Type literals that belong to one deployment's own platform.

    ``platform_type`` marks control readings (asset type, service, references, commands),
    ``app_type`` the asset type of applications. Set them to what the producers write.
    """

    platform_type: str = "Platform"
    app_type: str = "PlatformApp"

    @property
    def reading_types(self) -> tuple[str, ...]:
        return (SAMPLES, CONDITION, EVENTS, METHOD, self.platform_type, UNAVAILABLE)

    @property
    def asset_types(self) -> tuple[str, ...]:
        return ("Device", MTCONNECT_AGENT, "KafkaProducer", self.app_type)


DEFAULT_VOCABULARY = Vocabulary()
