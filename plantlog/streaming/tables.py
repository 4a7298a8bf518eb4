"""Continuous tables with removals, kept by stateful processors.

A changelog table keeps per key the position and the payload of its last change. Rows leave as changes:
``op`` is ``upsert`` or ``delete``, so a removal reaches the sink and every table behind it. A change below the
position already seen is old and ignored, whatever file or partition brought it late; a removed key
keeps its position for that. Payloads travel as JSON objects of the declared columns.

Each task folds its rows of a micro-batch to the last one per key before they are shuffled, so a key that
changes all the time costs a row per task and batch. Keys are dealt into groups, and a processor is called
once per group and batch; its state lies in pages (``groups.Pages``): a removed or old key costs its position,
an asset its signals. The sink is an upsert log whose folders belong to batches, so a repeated batch replaces itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from plantlog.streaming.groups import Pages, by_group
from plantlog.streaming.jobs import stream_table

UPSERT, DELETE = "upsert", "delete"
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_CHANGE = "key string, position long, payload string"


def changes(changelog: DataFrame, key: str, payload: list[str], position: Column | str = "offset",
            removed: Column | None = None) -> DataFrame:
    """A changelog as (``key``, ``position``, ``payload``); a NULL payload removes its key. By default a row
    removes when all its payload columns are NULL."""
    gone = removed if removed is not None else ~F.greatest(*[F.col(c).isNotNull() for c in payload], F.lit(False))
    body = F.to_json(F.struct(*payload), {"ignoreNullFields": "false", **_MICROS})
    at = F.col(position) if isinstance(position, str) else position
    return changelog.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), at.cast("long").alias("position"), F.when(~gone, body).alias("payload"))


def _last_per_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last: dict[tuple, int] = {}
        key = list(zip(*(batch.column(c).to_pylist() for c in batch.schema.names if c not in ("position", "payload"))))
        position = batch.column("position").to_pylist()
        for i, k in enumerate(key):
            if k not in last or position[i] >= position[last[k]]:
                last[k] = i
        yield batch.take(pa.array(sorted(last.values()), pa.int64()))


def last_per_task(rows: DataFrame) -> DataFrame:
    """The last row per key of every Arrow batch: fewer rows for the shuffle, the same table."""
    return rows.mapInArrow(_last_per_key, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


class _Changelog(StatefulProcessor):
    """Per key the position of its last change and whether the table has it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = Pages(handle, "current")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple] = {}
        for batch in rows:
            for k, position, payload in zip(*(batch[c].tolist() for c in ("key", "position", "payload"))):
                if k not in best or position >= best[k][0]:
                    best[k] = (int(position), payload)
        before, changed, out = self.current.read(best), {}, []
        for k, (position, payload) in best.items():
            last, live = before.get(k, (position, False))
            if position < last:
                continue
            changed[k] = (position, payload is not None)
            if payload is not None or live:
                out.append((k, position, payload, UPSERT if payload is not None else DELETE))
        self.current.write(changed)
        if out:
            yield pd.DataFrame(out, columns=["key", "position", "payload", "op"])

    def close(self) -> None:
        pass


def table_updates(rows: DataFrame) -> DataFrame:
    """Changes (``key``, ``position``, ``payload``, ``op``) of the table that the stream ``rows`` of
    :func:`changes` describes."""
    return by_group(last_per_task(rows), "key").transformWithStateInPandas(
        _Changelog(), f"{_CHANGE}, op string", "Update", "None")


def stream_changelog_table(rows: DataFrame, location: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps a changelog table: the name map, connector configurations, metric targets, types."""
    return stream_table(table_updates(rows), location, checkpoint, trigger)


def read_table(spark: SparkSession, location: str, payload: StructType | str, key: str = "key") -> DataFrame:
    """Current rows of a continuous table: the newest change per key, without the removed ones."""
    log = spark.read.parquet(location)
    last = log.groupBy("key").agg(F.max_by(F.struct("payload", "op"), F.struct("position", "batch_id")).alias("r"))
    return last.where(F.col("r.op") == UPSERT).select(
        F.col("key").alias(key), F.from_json("r.payload", payload, _MICROS).alias("p")).select(key, "p.*")


class _PerAsset(StatefulProcessor):
    """Assets with their names and signals: position and text of the name, position and payload per signal."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.assets = Pages(handle, "assets")

    def touched(self, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        """Stores the rows. Per asset they touch: the name and the signals it had, position and text of the name
        it has now, which signals changed, and all signals."""
        names: dict[str, tuple] = {}
        fresh: dict[str, dict[str, tuple]] = {}
        for batch in rows:
            for asset, kind, id_, position, payload in zip(*(batch[c].tolist() for c in (
                    "asset_uuid", "kind", "id", "position", "payload"))):
                if kind == "name":
                    if asset not in names or position >= names[asset][0]:
                        names[asset] = (int(position), json.loads(payload)["uns_id"] if payload is not None else None)
                else:
                    own = fresh.setdefault(asset, {})
                    if id_ not in own or position >= own[id_][0]:
                        own[id_] = (int(position), payload)
        every = names.keys() | fresh.keys()
        known, changed, found = self.assets.read(every), {}, []
        for asset in every:
            at, name, signals = known.get(asset, (-1, None, []))
            now = names[asset] if asset in names and names[asset][0] >= at else (at, name)
            have = {id_: (p, payload) for id_, p, payload in signals}
            new = {id_: v for id_, v in fresh.get(asset, {}).items() if id_ not in have or v[0] >= have[id_][0]}
            if new or now != (at, name):
                changed[asset] = (*now, [(id_, *v) for id_, v in {**have, **new}.items()])
                found.append((asset, name, list(have), now, new, {**have, **new}))
        self.assets.write(changed)
        return found

    def close(self) -> None:
        pass


class _Named(_PerAsset):
    """Signals of assets under the names they have now."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for asset, before, ids, (at, name), changed, every in self.touched(rows):
            if name != before:
                # Another name: what stood under the old one goes, all signals come under the new one.
                changed = every
                if before is not None:
                    out += [(asset, f"{before}|{id_}", at, None, DELETE) for id_ in ids]
            if name is not None:
                out += [(asset, f"{name}|{id_}", at, json.dumps({**json.loads(payload), "uns_id": name}), UPSERT)
                        for id_, (_, payload) in changed.items()]
        if out:
            yield pd.DataFrame(out, columns=["owner", "key", "position", "payload", "op"])


STATE_PAYLOAD = ["asset_uuid", "id", "value", "type", "tag", "timestamp"]


def _asset_rows(state_updates: DataFrame) -> DataFrame:
    body = F.to_json(F.struct(*STATE_PAYLOAD), {"ignoreNullFields": "false"})
    return state_updates.select("asset_uuid", "id", F.lit("reading").alias("kind"), F.col("position").cast("long").alias(
        "position"), body.alias("payload"))


def stream_state_by_uns(state_updates: DataFrame, names: DataFrame, location: str, checkpoint: str,
                        trigger: dict | None = None) -> StreamingQuery:
    """The state under today's names, continuously and retroactively: a change of a name rewrites the rows of
    its asset and removes those under the old name; no other asset is touched.

    ``state_updates`` are changed rows of the state table (``STATE_PAYLOAD`` and ``position``), ``names``
    changes of the map (``asset_uuid``, ``uns_id``, ``offset``). Each side meets the stored other side, so it does not
    matter which arrives first."""
    renamed = changes(names, "asset_uuid", ["uns_id"]).select(
        F.col("key").alias("asset_uuid"), F.lit(None).cast("string").alias("id"), F.lit("name").alias("kind"), "position", "payload")
    rows = last_per_task(_asset_rows(state_updates).unionByName(renamed))
    named = by_group(rows, "asset_uuid").transformWithStateInPandas(
        _Named(), "owner string, key string, position long, payload string, op string", "Update", "None")
    return stream_table(named, location, checkpoint, trigger)


def read_state_by_uns(spark: SparkSession, location: str) -> DataFrame:
    """``key``, ``uns_id`` and the state columns. Two assets may have carried one name: the rows are folded per
    owner, as the batch join shows them."""
    last = spark.read.parquet(location).groupBy("owner", "key").agg(
        F.max_by(F.struct("payload", "op"), "batch_id").alias("r")).where(F.col("r.op") == UPSERT)
    payload = ", ".join(f"{c} string" for c in [*STATE_PAYLOAD, "uns_id"])
    return last.select("key", F.from_json("r.payload", payload).alias("p")).select("key", "p.*")


class _Readings(_PerAsset):
    """All signals of an asset, given out once per batch that changed one."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for asset, _, _, _, changed, every in self.touched(rows):
            if changed:
                all_ = sorted(((id_, payload) for id_, (_, payload) in every.items()), key=lambda x: x[0].encode())
                out.append((asset, "[" + ",".join(p for _, p in all_) + "]"))
        if out:
            yield pd.DataFrame(out, columns=["asset_uuid", "readings"])


def stream_readings_by_asset(state_updates: DataFrame, location: str, checkpoint: str,
                             trigger: dict | None = None) -> StreamingQuery:
    """The readings of every asset in one array, rewritten once per batch for the assets that changed."""
    rows = last_per_task(_asset_rows(state_updates))
    return stream_table(by_group(rows, "asset_uuid").transformWithStateInPandas(
        _Readings(), "asset_uuid string, readings string", "Update", "None"), location, checkpoint, trigger)


def read_readings(spark: SparkSession, location: str) -> DataFrame:
    last = spark.read.parquet(location).groupBy("asset_uuid").agg(F.max_by("readings", "batch_id").alias("r"))
    return last.select("asset_uuid", F.from_json(
        "r", "array<struct<id:string,value:string,type:string,tag:string,timestamp:string>>").alias("readings"))


def state_updates(spark: SparkSession, location: str, per_trigger: int | None = None) -> DataFrame:
    """The upsert log of ``stream_latest_state`` as a stream of changed rows; a later batch counts more."""
    reader = spark.readStream.schema(", ".join(f"{c} string" for c in ["key", *STATE_PAYLOAD]) + ", batch_id long")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(location).withColumn("position", F.col("batch_id"))
