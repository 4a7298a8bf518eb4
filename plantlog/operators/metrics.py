"""Delivery metrics: counters, histograms, reset-aware rates, bucket quantiles.

Rates follow one rule: increase of a counter (a drop means it restarted, so its new value is the
increase) over aligned one-minute windows divided by 60, without extrapolation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantlog.functions import epoch_millis, parse_time
from plantlog.operators.routing import route

WINDOW_SECONDS = 60
INFINITY = float("inf")


# ---- From messages -----------------------------------------------------------------------

FORWARDER_COUNTERS = ("consumed", "kafka_errors", "invalid", "consume_calls")
CLUSTER_COUNTERS = ("published", "publish_failures")


def asset_counters(outcomes: DataFrame) -> DataFrame:
    """All counters per forwarder and asset: the one pass over the messages that both tables share.

    ``outcomes`` has one row per message: ``forwarder, asset_uuid, is_error, is_invalid, is_failed,
    opens_call`` (booleans). A message counts as published or as a failure only if it was readable
    and valid.
    """
    read = ~F.col("is_error")
    sent = read & ~F.col("is_invalid")
    return outcomes.groupBy("forwarder", "asset_uuid").agg(
        F.count_if(read).alias("consumed"), F.count_if("is_error").alias("kafka_errors"),
        F.count_if(read & F.col("is_invalid")).alias("invalid"),
        F.count_if("opens_call").alias("consume_calls"),
        F.count_if(sent & ~F.col("is_failed")).alias("published"),
        F.count_if(sent & F.col("is_failed")).alias("publish_failures"))


def forwarder_counters(per_asset: DataFrame) -> DataFrame:
    """:data:`FORWARDER_COUNTERS` of each forwarder from :func:`asset_counters`."""
    return per_asset.groupBy("forwarder").agg(*[F.sum(c).alias(c) for c in FORWARDER_COUNTERS])


def cluster_counters(per_asset: DataFrame, nodes: list[str], **kwargs) -> DataFrame:
    """:data:`CLUSTER_COUNTERS` of each cluster that something was sent to. Assets are hashed, not
    their messages."""
    sent = per_asset.where(F.col("published") + F.col("publish_failures") > 0)
    return route(sent, nodes, **kwargs).groupBy("cluster").agg(
        *[F.sum(c).alias(c) for c in CLUSTER_COUNTERS])


def bucket_names(bounds: tuple) -> list[str]:
    """Column names of the buckets of a wide histogram, +Inf last."""
    return [f"le_{i}" for i in range(len(bounds))] + ["count"]


def histogram_columns(observations: DataFrame, value: str, bounds: tuple,
                      by: list[str]) -> DataFrame:
    """Cumulative buckets as columns ``le_0 … le_n, count`` plus ``sum``: one row per group.

    ``count`` is the +Inf bucket. One aggregation with one counter per bound.
    """
    counts = [F.expr(f"count_if(`{value}` <= {float(b)!r}D) AS {n}")
              for n, b in zip(bucket_names(bounds), bounds)]
    return observations.groupBy(*by).agg(
        *counts, F.count(value).alias("count"), F.sum(value).alias("sum"))


def _bucket_array(bounds: tuple) -> Column:
    limits = [f"{float(b)!r}D" for b in bounds] + ["double('Infinity')"]
    return F.expr("array(" + ", ".join(
        f"named_struct('le', {le}, 'value', {n})"
        for le, n in zip(limits, bucket_names(bounds))) + ")")


def histogram(observations: DataFrame, value: str, bounds: tuple, by: list[str]) -> DataFrame:
    """Cumulative buckets as rows ``(*by, le, value)``, the last one +Inf, plus ``sum`` and
    ``count``. Rows multiply only after the aggregation."""
    wide = histogram_columns(observations, value, bounds, by)
    return wide.select(*by, F.explode(_bucket_array(bounds)).alias("x"), "sum", "count").select(
        *by, "x.le", "x.value", "sum", "count")


def gauge_current(samples: DataFrame, label: str, value: str, ts: str = "ts") -> DataFrame:
    return samples.groupBy(label).agg(F.max_by(value, ts).alias(value))


def latest_labels(samples: DataFrame, by: str, labels: list[str],
                  constants: dict[str, str]) -> DataFrame:
    """Newest label set of each series with the constant labels added."""
    newest = samples.groupBy(by).agg(F.max_by(F.struct(*labels), "ts").alias("l"))
    return newest.select(by, *[F.col(f"l.{n}").alias(n) for n in labels],
                         *[F.lit(v).alias(k) for k, v in constants.items()])


# ---- From counter samples ----------------------------------------------------------------

def counter_rates(samples: DataFrame, by: list[str], counters: dict[str, str], ts: str = "ts",
                  window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Per-second rates of counters ``{column: name of its rate}`` per series and aligned window.

    Samples are compared inside their window first, which never gathers more than one window of
    one series; the step between windows uses each window's first and last sample only. All
    counters of a series are handled in the same pass.
    """
    values = F.struct(*counters)
    rows = samples.select(*by, F.col(ts).cast("timestamp").alias("_ts"), values.alias("_v"))
    rows = rows.withColumn("window_start", F.window("_ts", f"{window_seconds} seconds")["start"])
    inside = Window.partitionBy(*by, "window_start").orderBy("_ts")
    rows = rows.withColumn("_p", F.lag("_v").over(inside))

    def increase(counter: str, now: str, before: str) -> str:
        # a drop means the counter restarted from zero
        now, before = f"{now}.`{counter}`", f"{before}.`{counter}`"
        return (f"CASE WHEN {before} IS NULL THEN 0 WHEN {now} < {before} THEN {now} "
                f"ELSE {now} - {before} END")

    per_window = rows.groupBy(*by, "window_start").agg(
        F.min_by("_v", "_ts").alias("_first"), F.max_by("_v", "_ts").alias("_last"),
        *[F.expr(f"sum({increase(c, '_v', '_p')}) AS _in_{i}") for i, c in enumerate(counters)])
    bordered = per_window.withColumn("_before", F.lag("_last").over(
        Window.partitionBy(*by).orderBy("window_start")))
    return bordered.select(*by, "window_start", *[
        F.expr(f"(_in_{i} + {increase(c, '_first', '_before')}) / {float(window_seconds)}D "
               f"AS `{out}`") for i, (c, out) in enumerate(counters.items())])


def counter_rate(samples: DataFrame, by: list[str], value: str = "value", ts: str = "ts",
                 out: str = "rate", window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """:func:`counter_rates` of one counter."""
    return counter_rates(samples, by, {value: out}, ts, window_seconds)


def ratio_of_rates(samples: DataFrame, by: list[str], total: str = "sum",
                   count: str = "count") -> DataFrame:
    """``rate(sum) / rate(count)`` per window: the mean observation; NULL in an idle window."""
    return counter_rates(samples, by, {total: "_s", count: "_c"}).select(
        *by, "window_start", F.try_divide("_s", "_c").alias("avg"))


def _with_quantile(df: DataFrame, q: float, out: str) -> DataFrame:
    """Quantile of the ordered bucket array ``b`` by linear interpolation."""
    df = df.withColumn("_total", F.element_at("b", -1)["value"]).withColumn(
        "_rank", F.col("_total") * F.lit(q))
    reached = F.array_position(F.transform("b", lambda x: x["value"] >= F.col("_rank")), True)
    df = df.withColumn("_i", reached.cast("int"))
    hit = F.try_element_at("b", F.nullif(F.col("_i"), F.lit(0)))
    prev = F.when(F.col("_i") > 1, F.try_element_at("b", F.col("_i") - 1))
    df = df.withColumn("_hit", hit).withColumn("_prev", prev)
    lo = F.coalesce(F.col("_prev.le"), F.lit(0.0))
    lo_count = F.coalesce(F.col("_prev.value"), F.lit(0.0))
    inside = lo + (F.col("_hit.le") - lo) * (F.col("_rank") - lo_count) / (
        F.col("_hit.value") - lo_count)
    value_at = (F.when(~(F.col("_total") > 0), F.lit(None).cast("double"))
                .when(F.col("_i") == F.size("b"), F.col("_prev.le"))
                .when((F.col("_i") == 1) & (F.col("_hit.le") <= 0), F.col("_hit.le"))
                .otherwise(inside))
    return df.withColumn(out, value_at).drop("b", "_total", "_rank", "_i", "_hit", "_prev")


def histogram_quantile(buckets: DataFrame, q: float, by: list[str], value: str = "rate",
                       out: str = "quantile") -> DataFrame:
    """Quantile of cumulative buckets ``(*by, le, value)``.

    The first bucket starts at 0 (or at its bound, when that is not positive). A rank in the +Inf
    bucket gives the highest finite bound; an empty histogram gives NULL. A group holds one row per
    bound, which is the only thing collected.
    """
    pairs = F.struct(F.col("le"), F.col(value).alias("value"))
    grouped = buckets.groupBy(*by).agg(F.sort_array(F.collect_list(pairs)).alias("b"))
    return _with_quantile(grouped, q, out)


def windowed_quantile(bucket_samples: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Quantile per window of cumulative bucket counters ``(*by, le, ts, value)``."""
    rates = counter_rate(bucket_samples, [*by, "le"])
    return histogram_quantile(rates, q, [*by, "window_start"])


def windowed_quantile_columns(samples: DataFrame, q: float, by: list[str], bounds: tuple,
                              out: str = "quantile") -> DataFrame:
    """The same of counters held as columns (:func:`histogram_columns` layout plus ``ts``): one
    row per series and sample instead of one per bucket, and no regrouping by bound."""
    names = bucket_names(bounds)
    rates = counter_rates(samples, by, {n: n for n in names})
    wide = rates.withColumn("b", _bucket_array(bounds)).drop(*names)
    return _with_quantile(wide, q, out)


# ---- From delivered messages -------------------------------------------------------------

def stage_latencies(messages: DataFrame, *also: str) -> DataFrame:
    """Milliseconds source → log and log → forwarder of each message, from its attributes.

    A stage with a missing or unreadable timestamp is NULL. ``also`` names columns to keep.
    """
    def at(name: str) -> Column:
        return epoch_millis(parse_time(F.col("attributes")[name]))

    return messages.select(
        "asset_uuid", "id", "offset", *also,
        (at("kafka_timestamp") - at("timestamp")).alias("source_to_log_ms"),
        (at("asset_forwarder_timestamp") - at("kafka_timestamp")).alias("log_to_forwarder_ms"))


#: Size of a latency sketch: a rank is off by about 0.7 % of the values, by at most 0.02 in the tests;
#: fewer values than this are kept exactly. A sketch has some kilobytes whatever it counts.
SKETCH_SIZE = 400


def latency_sketches(latencies: DataFrame, value: str, by: list[str]) -> DataFrame:
    """A mergeable quantile sketch of ``value`` (BIGINT) per group, to be stored per asset and hour.

    Tasks send sketches and not values, so a hot asset costs a sketch per task. NULLs are not counted.
    """
    return latencies.groupBy(*by).agg(
        F.kll_sketch_agg_bigint(F.col(value), F.lit(SKETCH_SIZE)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Stored sketches rolled up to coarser groups."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_SIZE)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """``n`` and the value at each rank (``{"p95": 0.95}``), NULL for a group without values."""
    n = F.kll_sketch_get_n_bigint("sketch")
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], n.alias("n"), *[
        F.when(n > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(r)))).alias(name)
        for name, r in ranks.items()])
