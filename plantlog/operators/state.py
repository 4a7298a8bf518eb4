"""Tables derived from the log: latest values, changelog folds, rollups, point-in-time state."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from plantlog import schema as S
from plantlog.functions import composite_key, log_micros, parse_time
from plantlog.operators import events as E
from plantlog.schema import DEFAULT_VOCABULARY, Vocabulary


# Columns of an enriched reading that may be NULL while its key is not.
_NULLABLE = ("value", "type", "tag")
_SIGNAL = ("asset_uuid", "id")


def latest_state(enriched: DataFrame, ignore_nulls: bool = True,
                 strategy: str = "single_pass") -> DataFrame:
    """Latest value of every column per asset and signal, by log offset.

    With ``ignore_nulls`` each column keeps its last non-NULL value on its own. Rows without a key
    belong to no signal. Groups are (asset_uuid, id), so that a filter on either goes below the
    aggregation and into the scan; ``key`` is built afterwards (an asset ``a|b`` with signal ``c``
    and an asset ``a`` with signal ``b|c`` stay apart under one key). Two plans give the same rows:

    ``single_pass`` aggregates ``max_by`` directly: one scan and a partial aggregation before the
    shuffle, so a hot key costs one row per task. Strings make it a sort aggregation, whose sort of
    a task's rows spills. Columns that are never NULL share one ``max_by``.
    ``two_pass`` first finds the winning offsets with a hash aggregation over longs, then fetches
    only those rows. It scans twice and never sorts the log; measure before choosing it.
    """
    keyed = enriched.where(F.col("key").isNotNull())
    if strategy == "two_pass":
        return _latest_two_pass(keyed, ignore_nulls)
    apart = _NULLABLE if ignore_nulls else ()
    together = [c for c in S.STATE_COLUMNS if c not in apart and c not in _SIGNAL]
    last = [F.expr(f"max_by({c}, offset) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in apart]
    folded = keyed.groupBy(*_SIGNAL).agg(F.max_by(F.struct(*together), "offset").alias("_r"), *last)
    return folded.select(composite_key().alias("key"), *[
        F.col(f"_r.{c}").alias(c) if c in together else F.col(c) for c in S.STATE_COLUMNS])


def _latest_two_pass(keyed: DataFrame, ignore_nulls: bool) -> DataFrame:
    apart = _NULLABLE if ignore_nulls else ()
    winners = keyed.groupBy(*_SIGNAL).agg(F.max("offset").alias("_at"), *[
        F.max(F.when(F.col(c).isNotNull(), F.col("offset"))).alias(f"_at_{c}") for c in apart])
    # the few offsets that hold a latest value of some column, with the columns they hold
    held = winners.select(*_SIGNAL, F.explode(F.array_distinct(F.array_compact(
        F.array("_at", *[f"_at_{c}" for c in apart])))).alias("offset"),
        "_at", *[f"_at_{c}" for c in apart])
    rows = keyed.join(held, [*_SIGNAL, "offset"])

    def at(column: str, position: str) -> Column:
        return F.max_by(column, F.when(F.col("offset") == F.col(position), 1)).alias(column)

    folded = rows.groupBy(*_SIGNAL).agg(*[
        at(c, f"_at_{c}" if c in apart else "_at") for c in S.STATE_COLUMNS if c not in _SIGNAL])
    return folded.select(composite_key().alias("key"), *S.STATE_COLUMNS)


def latest_signals(events: DataFrame, signals: list[str], **kwargs) -> DataFrame:
    """Latest state of chosen signals straight from the log.

    A key fixes its signal, so the filter goes below the aggregation (and into the scan), where a
    filter on the finished state cannot go.
    """
    return latest_state(E.enrich(events.where(F.col("id").isin(*signals))), **kwargs)


def write_state(state: DataFrame, location: str) -> None:
    """Store a state table ordered by key, so that a lookup by key reads few row groups."""
    (state.repartitionByRange("key").sortWithinPartitions("key")
     .write.mode("overwrite").parquet(location))


def latest_by_timestamp(enriched: DataFrame) -> DataFrame:
    """Latest reading per key by its own event time, ties by offset.

    A reading with no parsable time ranks before every timed one.
    """
    order = F.struct(F.coalesce(parse_time(F.col("timestamp")),
                                F.lit("0001-01-01 00:00:00").cast("timestamp")), F.col("offset"))
    rest = [c for c in S.STATE_COLUMNS if c not in _SIGNAL]
    folded = enriched.where(F.col("key").isNotNull()).groupBy(*_SIGNAL).agg(
        F.max_by(F.struct(*rest), order).alias("s"))
    return folded.select(composite_key().alias("key"), *_SIGNAL, "s.*")


def state_as_of(enriched: DataFrame, offset: int | dict[int, int] | None = None,
                log_time: str | None = None, **kwargs) -> DataFrame:
    """The state a reader would have seen at a past position and/or log time.

    Offsets of different partitions are unrelated: a log of several partitions takes a dict of
    partition to last offset (partitions without one count in full), or a log time.
    """
    past = enriched
    if isinstance(offset, dict):
        last = F.create_map(*[F.lit(int(x)) for item in offset.items() for x in item])
        past = past.where(F.col("offset") <= F.coalesce(
            F.try_element_at(last, F.col("partition").cast("int")), F.lit(2**63 - 1)))
    elif offset is not None:
        past = past.where(F.col("offset") <= offset)
    if log_time is not None:
        past = past.where(F.col("log_time") <= F.lit(log_time).cast("timestamp"))
    return latest_state(past, **kwargs)


def readings_by_asset(state: DataFrame) -> DataFrame:
    """Every live signal of an asset in one array, ordered by signal id.

    The array holds one element per *signal*, never one per reading: the log is folded to
    ``state`` before anything is collected.
    """
    reading = F.struct("id", "value", "type", "tag", "timestamp")
    return state.groupBy("asset_uuid").agg(F.sort_array(F.collect_list(reading)).alias("readings"))


def changelog_snapshot(changelog: DataFrame) -> DataFrame:
    """Fold ``(k, v, offset)`` to the current table; a NULL ``v`` deletes its key."""
    # the wrapper keeps a NULL v as a candidate for the maximum
    return (changelog.where(F.col("k").isNotNull())
            .groupBy("k").agg(F.max_by(F.struct("v"), "offset")["v"].alias("v"))
            .where(F.col("v").isNotNull()).select("k", "v.*"))


def last_change(changes: DataFrame, column: str) -> DataFrame:
    """Last value of ``column`` per asset; NULL stands for a removed asset.

    This is the form a streaming table emits, where a removal must reach the sink.
    """
    return changes.where(F.col("asset_uuid").isNotNull()).groupBy("asset_uuid").agg(
        F.max_by(F.struct(column), "offset")[column].alias(column))


def with_removals(changes: DataFrame, removals: DataFrame | None, target: str) -> DataFrame:
    """``changes`` and the tombstones of ``removals`` (``asset_uuid, target, log_time``) that go to one
    table. Tombstones have no offset in the log of ``changes``: ``log_time`` places them."""
    if removals is None:
        return changes
    gone = removals.where(F.col("target") == target)
    return changes.unionByName(gone.select("asset_uuid", "log_time", *[
        F.lit(None).cast(f.dataType).alias(f.name) for f in changes.schema.fields
        if f.name not in ("asset_uuid", "log_time")]))


def _last(changes: DataFrame, payload: list[str], removals: DataFrame | None, target: str) -> DataFrame:
    """``asset_uuid`` and ``m``, the last payload by offset; NULL when the asset's last removal is not
    earlier in log time than that payload. One shuffle of one pre-aggregated row per asset and task."""
    marked = with_removals(changes.withColumn("_own", F.lit(True)), removals, target)
    at, own = log_micros(), F.col("_own").isNotNull()
    folded = marked.where(F.col("asset_uuid").isNotNull()).groupBy("asset_uuid").agg(
        F.max_by(F.struct(F.struct(*payload).alias("m"), at.alias("at")), F.when(own, F.col("offset"))).alias("l"),
        F.max(F.when(~own, at)).alias("gone"))
    stays = F.col("gone").isNull() | (F.col("gone") < F.col("l.at"))
    return folded.select("asset_uuid", F.when(stays, F.col("l.m")).alias("m"))


def _current(changes: Callable[..., DataFrame], column: str, removals: DataFrame | None) -> DataFrame:
    """The table that ``changes(also=columns to keep)`` and the removals of the same name describe."""
    table = _TABLES[column]
    values = (last_change(changes(), column) if removals is None else
              _last(changes(also=("log_time",)), [column], removals, table).select("asset_uuid", f"m.{column}"))
    return values.where(F.col(column).isNotNull())


_TABLES = {"type": "assets_type", "availability": "assets_avail", "docker_service": "docker_services"}


def assets_type(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY,
                removals: DataFrame | None = None) -> DataFrame:
    return _current(partial(E.type_changes, events, vocab), "type", removals)


def assets_avail(events: DataFrame, removals: DataFrame | None = None) -> DataFrame:
    return _current(partial(E.availability_changes, events), "availability", removals)


def docker_services(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY,
                    removals: DataFrame | None = None) -> DataFrame:
    return _current(partial(E.service_changes, events, vocab), "docker_service", removals)


def uns_map(changelog: DataFrame, removals: DataFrame | None = None) -> DataFrame:
    """Current name map; an unmapped or removed asset stays with a NULL ``uns_id``."""
    payload = [c for c in changelog.columns if c not in ("asset_uuid", "offset", "log_time")]
    if removals is not None:
        return _last(changelog, payload, removals, "asset_to_uns_map").select("asset_uuid", "m.*")
    return (changelog.groupBy("asset_uuid")
            .agg(F.max_by(F.struct(*payload), "offset").alias("m")).select("asset_uuid", "m.*"))


def merge_resync(cache: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Refresh a cached state: snapshot rows replace or add, other cached rows stay."""
    s = snapshot.withColumn("_new", F.lit(True)).alias("s")
    c = cache.alias("c")
    joined = c.join(s, keys, "full_outer")
    rest = [n for n in cache.columns if n not in keys]
    return joined.select(*keys, *[
        F.when(F.col("_new"), F.col(f"s.{n}")).otherwise(F.col(f"c.{n}")).alias(n) for n in rest])
