"""Order-dependent operators that stay parallel when one key owns most of the log.

A window partitioned by asset alone puts a hot asset into one task. Here the order axis is cut
into buckets: the window runs per (key, bucket), and what must cross a bucket border is folded
first from one pre-aggregated row per (key, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantlog.functions.sizing import BROADCAST_ROWS

# Order positions per bucket: bounds the rows one window group can hold.
BUCKET_WIDTH = 1_000_000
# Log time of records that carry none: they stand before all others.
UNTIMED = -2**62
# Versions per key up to which the broadcast interval join is used.
VERSIONS_PER_KEY = 64


def log_micros() -> Column:
    """Place of a record among those of other logs: its log time in microseconds.

    Offsets order the records of one partition and say nothing about those of another log.
    """
    return F.coalesce(F.unix_micros("log_time"), F.lit(UNTIMED))


def _bucket(order: str, width: int) -> Column:
    return F.expr(f"`{order}` div {int(width)}")


def _carry_in(per_bucket: DataFrame, keys: list[str]) -> DataFrame:
    """Last non-NULL ``_v`` of all earlier buckets, one row per (key, bucket)."""
    before = (Window.partitionBy(*keys).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    return per_bucket.select(
        *keys, "_bucket", F.last("_v", ignorenulls=True).over(before).alias("_v"))


def version_intervals(versions: DataFrame, keys: list[str], order: str,
                      payload: list[str]) -> DataFrame:
    """Each version with the half-open range ``[_from, _to)`` in which it is in force."""
    w = Window.partitionBy(*keys).orderBy(order)
    return versions.select(
        *keys, *payload, F.col(order).alias("_from"),
        F.coalesce(F.lead(order).over(w), F.lit(2**63 - 1)).alias("_to"))


def _few_versions(versions: DataFrame, keys: list[str]) -> bool:
    counts = versions.groupBy(*keys).count()
    row = counts.agg(F.sum("count").alias("n"), F.max("count").alias("m")).first()
    return (row["n"] or 0) <= BROADCAST_ROWS and (row["m"] or 0) <= VERSIONS_PER_KEY


def asof_join(facts: DataFrame, versions: DataFrame, keys: list[str], order: str,
              payload: list[str], strategy: str = "auto",
              bucket_width: int = BUCKET_WIDTH) -> DataFrame:
    """Left as-of join: every fact gets the version in force at its position.

    A version at the same position as a fact applies to it. ``(keys, order)`` is unique among the
    versions. ``broadcast`` joins facts to version intervals without shuffling them; ``bucketed``
    shuffles facts by (keys, bucket) and holds for version tables of any size. ``auto`` measures
    the versions first. ``order`` is a BIGINT axis shared by both sides.
    """
    versions = versions.dropna(subset=keys)
    if strategy == "auto":
        strategy = "broadcast" if _few_versions(versions, keys) else "bucketed"
    if strategy == "broadcast":
        ranges = version_intervals(versions, keys, order, payload)
        renamed = ranges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *payload, "_from", "_to")
        cond = (F.col(order) >= F.col("_from")) & (F.col(order) < F.col("_to"))
        for k in keys:
            cond = (F.col(k) == F.col(f"_k_{k}")) & cond
        return facts.join(F.broadcast(renamed), cond, "left").select(*facts.columns, *payload)

    v = versions.select(*keys, _bucket(order, bucket_width).alias("_bucket"),
                        F.col(order).alias("_o"), F.struct(*payload).alias("_v"))
    e = facts.select(*keys, _bucket(order, bucket_width).alias("_bucket"),
                     F.col(order).alias("_o"), F.struct(*facts.columns).alias("_e"))
    last = v.groupBy(*keys, "_bucket").agg(F.max_by("_v", "_o").alias("_v"))
    # (key, bucket) pairs that hold facts, told apart from version rows by a NULL _v
    wanted = e.select(*keys, "_bucket").distinct()
    per_bucket = last.join(wanted, [*keys, "_bucket"], "full_outer")
    carry = _carry_in(per_bucket, keys).where(F.col("_v").isNotNull())

    no_event = F.lit(None).cast(e.schema["_e"].dataType).alias("_e")
    no_version = F.lit(None).cast(v.schema["_v"].dataType).alias("_v")
    rows = (
        carry.select(*keys, "_bucket", F.lit(-2**63).alias("_o"), F.lit(0).alias("_p"), "_v", no_event)
        .unionByName(v.select(*keys, "_bucket", "_o", F.lit(1).alias("_p"), "_v", no_event))
        .unionByName(e.select(*keys, "_bucket", "_o", F.lit(2).alias("_p"), no_version, "_e"))
    )
    w = (Window.partitionBy(*keys, "_bucket").orderBy("_o", "_p")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.withColumn("_v", F.last("_v", ignorenulls=True).over(w))
            .where(F.col("_e").isNotNull())
            .select("_e.*", *[F.col(f"_v.{p}").alias(p) for p in payload]))


def lag_in_order(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                 bucket_width: int = BUCKET_WIDTH) -> DataFrame:
    """``lag(value)`` per key in the given order, without one task per key.

    The first column of ``order`` is the BIGINT axis that is cut into buckets. The value is
    wrapped in a struct so that a NULL is carried as a value and not skipped.
    """
    b = df.withColumn("_bucket", _bucket(order[0], bucket_width))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    wrapped = b.withColumn("_lag", F.lag(F.struct(F.col(value).alias("v"))).over(inner))
    last = b.groupBy(*keys, "_bucket").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_v"))
    carry = _carry_in(last, keys)
    safe = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    cond = F.col("_bucket") == F.col("_b")
    for s in safe:
        cond = s & cond
    carry = carry.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                         F.col("_bucket").alias("_b"), F.col("_v").alias("_in"))
    return (wrapped.join(carry, cond, "left")
            .select(*df.columns, F.coalesce(F.col("_lag"), F.col("_in"))["v"].alias(out)))
