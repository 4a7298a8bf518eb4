"""Thinning of signal series: sampling intervals and deadbands."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from plantlog.functions.sizing import bounded_rows

# Readings per chunk of a deadband run: bounds what one task holds of one series.
CHUNK_ROWS = 200_000


def sample_interval(readings: DataFrame, interval_seconds: float | Column, keys: list[str],
                    ts: str = "log_time", order: str = "offset") -> DataFrame:
    """Last reading per signal and sampling interval; interval 0 keeps every change.

    The interval is one number, or a column with the setting of each reading's signal (see
    ``connectors.with_subscription``); a signal without a setting, or with 0, keeps every change in
    a slot of its own time.
    """
    rest = [c for c in readings.columns if c not in keys]
    if not isinstance(interval_seconds, Column):
        if not interval_seconds:
            return readings
        slot = F.window(ts, f"{int(interval_seconds * 1000)} milliseconds")["start"]
        kept = readings.withColumn("slot", slot).groupBy(*keys, "slot")
    else:
        width = (interval_seconds * 1_000_000).cast("bigint")
        at = F.unix_micros(ts)
        thin = F.coalesce(width > 0, F.lit(False))
        slot = F.when(thin, F.timestamp_micros(at - F.pmod(at, width))).otherwise(F.col(ts))
        kept = readings.withColumn("_each", F.when(~thin, F.col(order))).withColumn(
            "slot", slot).groupBy(*keys, "slot", "_each")
    return kept.agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "slot", "r.*")


def finite(rows: DataFrame, value: str) -> DataFrame:
    """Rows whose ``value`` is a finite number."""
    x = F.col(value).cast("double")
    return rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _walk(values: np.ndarray, band: float, last: float) -> list[int]:
    """Positions kept after ``last`` (NaN: nothing kept so far, the first one is)."""
    kept = []
    for i, v in enumerate(values.tolist()):
        if not abs(v - last) < band:
            kept.append(i)
            last = v
    return kept


def _walk_ends(values: list[float], band: float) -> list[float]:
    """For a walk starting at each reading: the value of the last reading it keeps.

    Read from the right, with the readings still reachable as a next high or next low on two
    stacks, so the next kept reading is a binary search whatever the shape of the series.
    """
    ends = list(values)
    high, high_at, low, low_at = [], [], [], []
    for i in range(len(values) - 1, -1, -1):
        v = values[i]
        h = bisect_right(high, -band, key=lambda x: v - x) - 1
        d = bisect_right(low, -band, key=lambda x: x - v) - 1
        following = [at for at in (high_at[h] if h >= 0 else None,
                                   low_at[d] if d >= 0 else None) if at is not None]
        if following:
            ends[i] = ends[min(following)]
        while high and high[-1] <= v:
            high.pop(), high_at.pop()
        while low and low[-1] >= v:
            low.pop(), low_at.pop()
        high.append(v), high_at.append(i), low.append(v), low_at.append(i)
    return ends


def _summary(values: np.ndarray, band: float) -> tuple[list[float], list[float]]:
    """How a chunk maps any incoming last-kept value to the outgoing one.

    Whatever value comes in, the first reading kept is a running maximum or minimum of the chunk,
    so those records with the value the walk from each of them ends on say everything.
    Returned flat: (position, value, outgoing value) triples of the rising and falling records.
    """
    ends = _walk_ends(values.tolist(), band)
    rising = np.flatnonzero(values > np.concatenate(
        ([-np.inf], np.maximum.accumulate(values)[:-1])))
    falling = np.flatnonzero(values < np.concatenate(
        ([np.inf], np.minimum.accumulate(values)[:-1])))

    def flat(records: np.ndarray) -> list[float]:
        return [x for i in records.tolist() for x in (float(i), float(values[i]), ends[i])]

    return flat(rising), flat(falling)


def _outgoing(last: float, rising: np.ndarray, falling: np.ndarray, band: float) -> float:
    if np.isnan(last):
        return rising[2]
    up, down = rising.reshape(-1, 3), falling.reshape(-1, 3)
    u = np.searchsorted(up[:, 1] - last, band, side="left")
    d = np.searchsorted(last - down[:, 1], band, side="left")
    hits = ([tuple(up[u])] if u < len(up) else []) + ([tuple(down[d])] if d < len(down) else [])
    return min(hits)[2] if hits else last


def _chunks_of_hot_series(rows: DataFrame, keys: list[str], order: str,
                          chunk_rows: int) -> DataFrame:
    """``(*keys, _bucket, _chunk)`` of the series longer than ``chunk_rows``.

    Readings are counted per order bucket and the counts are summed up along the series, so a
    chunk holds fewer than twice ``chunk_rows`` readings however unevenly they arrive. There are at
    most (all readings / chunk_rows) such series; every other series is one chunk.
    """
    hot = rows.groupBy(*keys).count().where(F.col("count") > chunk_rows).select(*keys)
    counts = rows.join(hot, keys, "left_semi").groupBy(*keys, "_bucket").agg(
        F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    return counts.select(*keys, "_bucket", F.floor(
        F.coalesce(F.sum("n").over(before), F.lit(0)) / chunk_rows).cast("bigint").alias("_chunk"))


def deadband_filter(readings: DataFrame, band: float | str, keys: list[str],
                    value: str = "value_num", order: str = "offset",
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Drop readings that differ from the last *kept* one of their signal by less than ``band``.

    ``band`` is one number, or the name of a column that holds each signal's setting (see
    ``connectors.with_subscription``); a signal with NULL, 0 or less keeps all its readings.

    The rule is sequential. A long series is cut into chunks: each is summarised on its own, the
    short summaries are folded in order to find the value every chunk starts from, and then all
    chunks (a short series being one) are filtered independently. A hot signal thus spreads over as
    many tasks as it has chunks. ``order`` is a BIGINT position, unique within a signal. Readings
    without a numeric value or a signal are no samples and drop out; so do NaN and infinite values, which
    are at no distance from anything.
    """
    rows = finite(readings.dropna(subset=[value, *keys]), value)
    if isinstance(band, str):
        on = F.coalesce(F.col(band) > 0, F.lit(False))
        free, rows = rows.where(~on), rows.where(on).withColumn("_band", F.col(band).cast("double"))
    elif band <= 0:
        return rows
    else:
        free, rows = None, rows.withColumn("_band", F.lit(float(band)))
    columns = readings.columns
    rows = rows.withColumn("_bucket", F.expr(f"`{order}` div {int(chunk_rows)}"))
    chunks = _chunks_of_hot_series(rows, keys, order, chunk_rows)
    group = [*keys, "_chunk"]
    cut = rows.select(*group[:-1], "_bucket", order, value, "_band").join(chunks, [*keys, "_bucket"])
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                        for f in cut.select(*group).schema.fields)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        own = float(pdf["_band"].iloc[0])
        up, down = _summary(pdf[value].to_numpy(dtype=float), own)
        head = {k: [pdf[k].iloc[0]] for k in group}
        return pd.DataFrame({**head, "_band": [own], "_up": [up], "_down": [down]})

    summaries = cut.groupBy(*group).applyInPandas(
        summarise, f"{key_ddl}, _band double, _up array<double>, _down array<double>")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, last = None, float("nan")
        for pdf in batches:
            entry = []
            for key, own, up, down in zip(pdf[keys].itertuples(index=False, name=None),
                                          pdf["_band"], pdf["_up"], pdf["_down"]):
                if key != series:
                    series, last = key, float("nan")
                entry.append(last)
                last = _outgoing(last, np.asarray(up), np.asarray(down), own)
            yield pdf[group].assign(_last=entry)

    # one pass over sorted summaries; only the current batch of them is in memory
    entries = (summaries.repartition(*keys).sortWithinPartitions(*group)
               .mapInPandas(fold, f"{key_ddl}, _last double"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, float("nan")
        for pdf in batches:
            if not len(pdf):
                continue
            fresh = np.zeros(len(pdf), dtype=bool)
            for k in group:
                col = pdf[k].to_numpy()
                fresh[1:] |= col[1:] != col[:-1]
            fresh[0] = tuple(pdf[group].iloc[0]) != current
            current = tuple(pdf[group].iloc[-1])
            kept = []
            for i, (v, new, start, own) in enumerate(zip(
                    pdf[value].tolist(), fresh.tolist(), pdf["_last"].astype(float).tolist(),
                    pdf["_band"].tolist())):
                if new:
                    last = start
                if not abs(v - last) < own:
                    kept.append(i)
                    last = v
            yield pdf.iloc[kept][columns]

    out_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in readings.schema.fields)
    starts = chunks.join(entries, group, "left")
    if bounded_rows(chunks):  # one row per chunk bucket, as in ``starts``, without the Python part
        starts = F.broadcast(starts)
    placed = rows.join(starts, [*keys, "_bucket"], "left").withColumn(
        "_chunk", F.coalesce("_chunk", F.lit(0)))
    thinned = placed.repartition(*group).sortWithinPartitions(*group, order).mapInPandas(walk, out_ddl)
    return thinned if free is None else thinned.union(free.select(*columns))
