"""Delivery with a commit protocol: a streaming sink whose batches appear whole, and once.

Tasks write their rows aside, one file per cluster; a file is seen by nobody until the batch is committed.
The commit message of a task names its files with their rows and sizes. Committing a batch writes one
manifest, put in place by a rename; readers see what manifests name. A failed task or batch leaves files
that no manifest names; a batch that comes again after its commit (a driver lost between the sink's commit
and Spark's) finds its manifest and removes its second copy. So every record is delivered at least once
to the sink and appears exactly once to readers. Counters of the same pass lie in the manifest.

Folder: any that driver and executors share and that pyarrow can open (a path or a URI).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

FORMAT, NO_CLUSTER = "plantlog_delivery", "dead_letters"
_MANIFEST = "batch bigint, committed_at double, files array<struct<path:string,cluster:string,rows:bigint,bytes:bigint>>"


def _open(location: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(location) if "://" in location else (fs.LocalFileSystem(), location.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: path below the folder, cluster, rows, bytes."""
    files: list[tuple[str, str, int, int]] = field(default_factory=list)


class DeliveryWriter(DataSourceStreamArrowWriter):
    def __init__(self, location: str):
        self.location = location

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.location)
        token, writers, counts = uuid.uuid4().hex, {}, {}
        try:
            for batch in iterator:
                owner = pc.fill_null(batch.column("cluster"), NO_CLUSTER)
                for cluster in pc.unique(owner).to_pylist():
                    rows = batch.filter(pc.equal(owner, cluster)).drop_columns(["cluster"])
                    if cluster not in writers:
                        # Named by number: a cluster's name may hold any character.
                        path = f"data/{token}-{len(writers)}.parquet"
                        fs.create_dir(f"{root}/data", recursive=True)
                        writers[cluster] = path, pq.ParquetWriter(f"{root}/{path}", rows.schema, filesystem=fs)
                    writers[cluster][1].write_batch(rows)
                    counts[cluster] = counts.get(cluster, 0) + rows.num_rows
        finally:
            for _, writer in writers.values():
                writer.close()
        return Written([(path, cluster, counts[cluster], fs.get_file_info(f"{root}/{path}").size)
                        for cluster, (path, _) in writers.items()])

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        fs, root = _open(self.location)
        name = f"{root}/manifests/{batchId:012d}.json"
        fs.create_dir(f"{root}/manifests", recursive=True)
        if fs.get_file_info(name).is_file:
            self.abort(messages, batchId)
            return
        files = [dict(zip(("path", "cluster", "rows", "bytes"), f)) for m in messages if m for f in m.files]
        aside = f"{root}/manifests/.{batchId:012d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as out:
            out.write(json.dumps({"batch": batchId, "committed_at": time.time(), "files": files}).encode())
        fs.move(aside, name)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        fs, root = _open(self.location)
        for m in messages:
            for path, *_ in m.files if m else ():
                if fs.get_file_info(f"{root}/{path}").is_file:
                    fs.delete_file(f"{root}/{path}")


class DeliverySource(DataSource):
    """``format(FORMAT)`` of a stream; option ``path`` is the folder. Rows need a column ``cluster``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema, overwrite: bool) -> DeliveryWriter:
        if "cluster" not in schema.names:
            raise ValueError("a delivery needs the column 'cluster'")
        return DeliveryWriter(self.options["path"])


def deliver(rows: DataFrame, location: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Streams ``rows`` (with ``cluster``; NULL goes to ``NO_CLUSTER``) into the committed folder."""
    rows.sparkSession.dataSource.register(DeliverySource)
    return (rows.writeStream.format(FORMAT).option("path", location).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())


def _files(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{location}/manifests").select("batch", F.explode("files").alias("f")).select(
        "batch", "f.*")


def read_delivered(spark: SparkSession, location: str, schema: str, cluster: str | None = None) -> DataFrame:
    """Delivered rows, with ``cluster``: the files that manifests name, those of one cluster if asked."""
    files = _files(spark, location)
    files = files if cluster is None else files.where(F.col("cluster") == cluster)
    out = None
    for name, paths in files.groupBy("cluster").agg(F.collect_list("path")).collect():
        part = spark.read.schema(schema).parquet(*[f"{location}/{p}" for p in paths]).withColumn("cluster", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"{schema}, cluster string")


def delivered_counts(spark: SparkSession, location: str) -> DataFrame:
    """Counters of the delivering pass: ``batch``, ``cluster``, ``rows``, ``bytes``; no row is read."""
    return _files(spark, location).groupBy("batch", "cluster").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def remove_uncommitted(spark: SparkSession, location: str, older_than_seconds: float = 86_400) -> int:
    """Deletes files that no manifest names and that are older than any batch still running; gives their number."""
    fs, root = _open(location)
    from pyarrow import fs as pafs
    named = {r["path"] for r in _files(spark, location).select("path").toLocalIterator()}
    limit, gone = time.time() - older_than_seconds, 0
    for info in fs.get_file_info(pafs.FileSelector(f"{root}/data", allow_not_found=True)):
        if f"data/{info.base_name}" not in named and info.mtime.timestamp() < limit:
            fs.delete_file(info.path)
            gone += 1
    return gone
