"""Continuous queries. Tables leave a stream as an upsert log: changed rows per micro-batch.

Each micro-batch owns one ``batch_id`` folder and overwrites it when it is retried, so an executor
or driver loss repeats a batch without repeating its rows. The current table is the fold of that
log, and compaction bounds what a reader has to fold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from plantlog.operators import events as E, state as St
from plantlog.operators.events import enrich
from plantlog.operators.routing import route
from plantlog.operators.uns import stream_by_uns
from plantlog.sources import parse_asset_events

DEAD_LETTERS = "dead_letters"


def upsert_sink(location: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of an upsert log; retrying a batch replaces its own rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{location}/batch_id={batch_id}")
    return write


def read_upserts(spark: SparkSession, location: str, keys: list[str]) -> DataFrame:
    """Current rows of an upsert log: the newest batch's row per key."""
    log = spark.read.parquet(location)
    rest = [c for c in log.columns if c not in keys and c != "batch_id"]
    return (log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
            .select(*keys, "r.*"))


def compact_upserts(spark: SparkSession, location: str, keys: list[str], target: str) -> DataFrame:
    """Write the folded log to a new folder as its base and return the frame read from it.

    The base is batch -1, so every batch written after it wins, a retried one included.
    """
    read_upserts(spark, location, keys).write.mode("overwrite").parquet(f"{target}/batch_id=-1")
    return spark.read.parquet(target)


def stream_table(updates: DataFrame, location: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Run a streaming aggregation in update mode into an upsert log."""
    return (updates.writeStream.outputMode("update").foreachBatch(upsert_sink(location))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_latest_state(events: DataFrame, location: str, checkpoint: str,
                        trigger: dict | None = None) -> StreamingQuery:
    """Latest state kept up to date from the asset stream.

    The state store holds one row per live signal; every batch writes only the changed ones.
    """
    return stream_table(St.latest_state(enrich(events)), location, checkpoint, trigger)


def push_query(df: DataFrame, location: str, checkpoint: str,
               trigger: dict | None = None) -> StreamingQuery:
    """Continuous result rows of a stateless query, appended as they arrive."""
    return (df.writeStream.outputMode("append").format("parquet").option("path", location)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def for_each_row_batch(df: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str,
                       trigger: dict | None = None) -> StreamingQuery:
    """Hand every micro-batch to a user callback ``(rows, batch_id)``.

    The callback gets a DataFrame, so its work stays on the executors. If it raises, the batch's
    offsets are not committed and the whole batch is delivered again.
    """
    return (df.writeStream.outputMode("append").foreachBatch(handler)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def deliver_by_uns(events: DataFrame, read_map: Callable[[], DataFrame], location: str,
                   checkpoint: str, trigger: dict | None = None, **kwargs) -> StreamingQuery:
    """The stream re-keyed by name, continuously.

    The map changelog is read again for each batch and joined as of each reading's position, so a
    replayed batch gives the same names it gave the first time.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        named = stream_by_uns(batch, read_map(), **kwargs)
        named.write.mode("overwrite").parquet(f"{location}/batch_id={batch_id}")
    return for_each_row_batch(events, write, checkpoint, trigger)


def delivery(records: DataFrame, nodes: list[str], forwarded_at: Column) -> DataFrame:
    """Raw log records as messages for their clusters: checked, stamped, given a subject and the
    payload without the id, routed. A record that cannot be delivered keeps its payload, has an
    ``error`` and goes to ``DEAD_LETTERS``. One pass, no shuffle."""
    checked = E.with_message_error(parse_asset_events(records, keep_payload=True))
    sent = route(E.subject_and_payload(E.delivery_timestamps(
        checked.withColumn("_raw", F.col("payload")), forwarded_at)), nodes)
    bad = F.col("error").isNotNull()
    return sent.select(
        F.when(bad, DEAD_LETTERS).otherwise(F.col("cluster")).alias("cluster"),
        F.when(~bad, F.col("subject")).alias("subject"),
        F.when(bad, F.col("_raw")).otherwise(F.col("payload")).alias("payload"),
        "partition", "offset", "error")


def deliver_to_clusters(records: DataFrame, nodes: list[str], location: str, checkpoint: str,
                        forwarded_at: Column | None = None,
                        trigger: dict | None = None) -> StreamingQuery:
    """The delivery job: each micro-batch owns ``batch_id=N`` with a folder per cluster and one for dead
    letters, and replaces it when it is delivered again."""
    at = F.current_timestamp() if forwarded_at is None else forwarded_at

    def write(batch: DataFrame, batch_id: int) -> None:
        delivery(batch, nodes, at).write.mode("overwrite").partitionBy("cluster").parquet(
            f"{location}/batch_id={batch_id}")
    return for_each_row_batch(records, write, checkpoint, trigger)
