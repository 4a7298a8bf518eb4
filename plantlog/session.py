"""Session settings the operators rely on, and the shared folder for written intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_FALLBACK: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Timestamps are UTC throughout; AQE splits skewed join partitions at run time."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Many log keys never repeat within a task; RocksDB keeps streaming state off-heap.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the cluster's shared ``spark.checkpoint.dir``.

    A machine-local folder serves only a local master; on a cluster every executor would write to
    its own disk, so a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir")
    if not root:
        app = spark.sparkContext.applicationId
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _FALLBACK:
            _FALLBACK[app] = tempfile.mkdtemp(prefix="plantlog-")
        root = _FALLBACK[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
