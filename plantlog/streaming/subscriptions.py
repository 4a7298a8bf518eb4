"""Subscriptions: which listeners a message reaches, and waiting for a value."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plantlog import schema as S
from plantlog.functions import numeric_or_null
from plantlog.schema import DEFAULT_VOCABULARY, Vocabulary
from plantlog.streaming.jobs import stream_table


def message_routes(messages: DataFrame, attributes: list[str],
                   vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """One row per (message, listener): ``any``, ``attribute``, Samples, Events, Condition.

    Method messages only reach ``contract``; a message of another type reaches nobody.
    """
    t = F.col("type")
    plain = t.isin(S.SAMPLES, S.CONDITION, S.EVENTS, vocab.platform_type)
    routes = F.array_compact(F.array(
        F.when(plain & F.col("id").isin(*attributes), F.lit("attribute")),
        F.when(plain, F.lit("any")),
        F.when(t.isin(S.SAMPLES, S.EVENTS, S.CONDITION), t),
        F.when(t == S.METHOD, F.lit("contract"))))
    return messages.withColumn("route", F.explode(routes))


def _comparable(reference: object) -> Column:
    """Stored value as something comparable with the reference: a number for samples."""
    if isinstance(reference, (int, float)) and not isinstance(reference, bool):
        return F.when(F.col("type") == S.SAMPLES, numeric_or_null(F.col("value")))
    return F.col("value")


def wait_until(events: DataFrame, signal: str, reference: object,
               comparison: Callable[[Column, Column], Column], since: datetime,
               timeout_seconds: int = 30) -> DataFrame:
    """Per asset: does ``signal`` satisfy ``comparison(value, reference)`` within the timeout?

    The value in force at ``since`` counts first, then every reading up to the timeout. Gives
    ``matched``, ``initial`` (matched without waiting) and the ``offset`` of the first match.
    ``comparison`` works on Columns (``operator.eq``, ``operator.gt``, …).
    """
    if not callable(comparison):
        raise TypeError(f"comparison must be callable, not {type(comparison).__name__}")
    start = F.lit(since).cast("timestamp")
    end = start + F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")
    rows = (events.where((F.col("id") == signal) & F.col("asset_uuid").isNotNull()
                         & F.col("value").isNotNull())
            .withColumn("_hit", F.coalesce(
                comparison(_comparable(reference), F.lit(reference)), F.lit(False)))
            .withColumn("_past", F.col("log_time") <= start))
    r = rows.groupBy("asset_uuid").agg(
        F.expr("max_by(struct(_hit, offset), offset) FILTER (WHERE _past)").alias("_now"),
        F.min(F.when(F.col("_hit") & ~F.col("_past") & (F.col("log_time") <= end),
                     F.col("offset"))).alias("_later"))
    initial = F.coalesce(F.col("_now._hit"), F.lit(False))
    # an asset whose first reading comes after ``since`` has no attribute to wait for
    return r.where(F.col("_now").isNotNull()).select(
        "asset_uuid", (initial | F.col("_later").isNotNull()).alias("matched"),
        initial.alias("initial"),
        F.when(initial, F.col("_now.offset")).otherwise(F.col("_later")).alias("offset"))


def stream_wait_until(events: DataFrame, *args, location: str, checkpoint: str, **kwargs):
    """Continuous :func:`wait_until`: a table with one row per asset, updated as readings arrive.

    The answer is a fold with one small state row per asset (value in force, first hit in time), so no
    watermark is needed and a reading from a lagging partition still counts. A row that says
    ``matched = false`` is final once every partition's log time has passed the deadline.
    """
    return stream_table(wait_until(events, *args, **kwargs), location, checkpoint)


class _Wait(StatefulProcessor):
    """One wait per asset, decided when event time has passed its deadline."""

    def __init__(self, deadline_ms: int):
        self.deadline_ms = deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "now_hit boolean, now_offset long, later long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = not self.seen.exists()
        hit, at, later = (None, None, None) if fresh else self.seen.get()
        for batch in rows:
            for past, is_hit, offset in zip(batch["past"].tolist(), batch["hit"].tolist(), batch["offset"].tolist()):
                if past and (at is None or offset >= at):
                    hit, at = bool(is_hit), int(offset)
                elif not past and is_hit and (later is None or offset < later):
                    later = int(offset)
        self.seen.update((hit, at, later))
        if fresh:
            self.handle.registerTimer(self.deadline_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hit, at, later = self.seen.get()
        self.seen.clear()
        if at is not None:
            found = at if hit else later
            yield pd.DataFrame({"asset_uuid": [key[0]], "matched": [found is not None], "initial": [bool(hit)],
                                "offset": pd.array([found], "Int64")})

    def close(self) -> None:
        pass


def stream_wait_result(events: DataFrame, signal: str, reference: object, comparison: Callable[[Column, Column], Column],
                       since: datetime, timeout_seconds: int = 30, delay: str = "10 minutes") -> DataFrame:
    """The final answers of :func:`wait_until`, as a stream: one row per asset once event time, less ``delay`` for
    partitions that lag, has passed the deadline; with it the asset's state goes. Event time advances with the
    whole log, so a signal that falls silent ends its wait too. Readings later than that are not counted."""
    start = F.lit(since).cast("timestamp")
    end = start + F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")
    # The condition on the event time keeps the filter above the watermark.
    rows = events.withWatermark("log_time", delay).where(
        (F.col("log_time") <= end) & (F.col("id") == signal) & F.col("asset_uuid").isNotNull() & F.col("value").isNotNull()).select(
        "asset_uuid", "offset", "log_time", (F.col("log_time") <= start).alias("past"), F.coalesce(
            comparison(_comparable(reference), F.lit(reference)), F.lit(False)).alias("hit"))
    moment = since if since.tzinfo else since.replace(tzinfo=timezone.utc)
    deadline = int(moment.timestamp() * 1000) + 1000 * int(timeout_seconds)
    return rows.groupBy("asset_uuid").transformWithStateInPandas(
        _Wait(deadline), "asset_uuid string, matched boolean, initial boolean, offset long", "Append", "EventTime")
