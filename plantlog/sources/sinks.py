"""Writers: log records, typed row appends, tombstones, per-cluster delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def as_records(readings: DataFrame, extra: Column | None = None) -> DataFrame:
    """Readings as keyed JSON records ready for a log.

    ``timestamp`` goes under ``attributes``; ``extra`` (a string map) is merged over it.
    """
    base = F.map_from_arrays(F.array(F.lit("timestamp")), F.array(F.col("timestamp")))
    if extra is None:
        attributes = base
    else:
        own = F.map_filter(base, lambda k, _: ~F.map_contains_key(F.coalesce(
            extra, F.create_map().cast("map<string,string>")), k))
        attributes = F.when(extra.isNull(), base).otherwise(F.map_concat(own, extra))
    value = F.to_json(
        F.struct(F.col("id").alias("ID"), F.col("value").alias("VALUE"), F.col("tag").alias("TAG"),
                 F.col("type").alias("TYPE"), attributes.alias("attributes")),
        {"ignoreNullFields": "false"})
    return readings.select(F.col("asset_uuid").alias("key"), value.alias("value"))


def write_records(records: DataFrame, location: str, *, fmt: str = "parquet",
                  checkpoint: str | None = None, folders: tuple[str, ...] = (), **options: str):
    """Append records to a topic or folder, there into sub-folders by the columns ``folders``. A streaming frame
    needs its ``checkpoint`` folder and yields the started query, which ends once all present input is written."""
    target = {"topic": location} if fmt == "kafka" else {"path": location}
    if records.isStreaming:
        return (records.writeStream.format(fmt).outputMode("append").partitionBy(*folders)
                .options(**target, **options).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    records.write.format(fmt).mode("append").partitionBy(*folders).options(**target, **options).save()
    return None


def append_rows(df: DataFrame, location: str, schema: T.StructType, fmt: str = "parquet") -> None:
    """Bulk append in the declared column order and types (names matched in any case)."""
    names = {c.lower(): c for c in df.columns}
    aligned = df.select(*[
        (F.col(names[f.name.lower()]) if f.name.lower() in names else F.lit(None))
        .cast(f.dataType).alias(f.name) for f in schema.fields])
    aligned.write.format(fmt).mode("append").save(location)


def tombstones(keys: DataFrame, key: str, like: T.StructType, offset: Column) -> DataFrame:
    """Changelog rows ``(k, NULL, offset)`` that delete the given keys."""
    return keys.select(F.col(key).alias("k"), F.lit(None).cast(like).alias("v"),
                       offset.cast("bigint").alias("offset"))


def write_by_cluster(routed: DataFrame, location: str, fmt: str = "parquet", job: str | None = None) -> None:
    """Deliver each message to the folder of the cluster owning its asset; no shuffle needed.

    With ``job``, the delivery's own folder ``job=<name>`` is replaced as a whole, so a job that runs again
    leaves no row twice; without, rows are appended. A message without a cluster goes to ``dead_letters``.
    """
    rows = routed.withColumn("cluster", F.coalesce("cluster", F.lit("dead_letters")))
    out = rows.write.format(fmt).mode("append" if job is None else "overwrite").partitionBy("cluster")
    out.save(location if job is None else f"{location}/job={job}")
