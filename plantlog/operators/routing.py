"""Consistent-hash routing of assets to delivery clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantlog.functions.sizing import BROADCAST_ROWS
from plantlog.schema import RING_REPLICAS

_HEX = "0123456789abcdef"


def _prefix_digits(positions: int) -> int:
    """Hex digits of the equi-join prefix: about four ring positions per prefix."""
    digits = 2
    while 16**digits * 4 < positions and digits < 4:
        digits += 1
    return digits


def hash_ring(spark: SparkSession, nodes: list[str],
              replicas: int = RING_REPLICAS) -> tuple[DataFrame, int]:
    """The ring as rows ``(prefix, lo, hi, cluster)`` and the number of prefix digits.

    Every node sits at ``replicas`` SHA-256 positions. A key belongs to the first position
    strictly above its own hash, so a range is ``[previous position, position)``; the range above
    the last position belongs to the first. Lower-case hex text sorts like the number. A range
    appears once per prefix it touches, which makes the lookup an equi-join on the prefix plus a
    range test. The table grows with the ring, not with the data.
    """
    if not nodes:
        raise ValueError("a ring needs at least one node")
    digits = _prefix_digits(len(nodes) * replicas)
    names = F.array(*[F.lit(n) for n in nodes])
    spots = (spark.range(1).select(F.explode(names).alias("cluster"))
             .withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
             .select(F.sha2(F.concat("cluster", F.lit("::"), F.col("r").cast("string")), 256)
                     .alias("pos"), "cluster"))
    ring = spots.agg(F.sort_array(F.collect_list(F.struct("pos", "cluster"))).alias("ring"))
    last = F.element_at("ring", -1)["pos"]
    ranges = F.concat(
        F.transform("ring", lambda p, i: F.struct(
            F.when(i == 0, F.lit("0")).otherwise(F.try_element_at("ring", i)["pos"]).alias("lo"),
            p["pos"].alias("hi"), p["cluster"].alias("cluster"))),
        F.array(F.struct(last.alias("lo"), F.lit("g").alias("hi"),
                         F.element_at("ring", 1)["cluster"].alias("cluster"))))

    def number(text: Column, at_end: int) -> Column:
        digits_of = F.rpad(F.substring(text, 1, digits), digits, "0")
        return F.when(text == "g", F.lit(at_end)).otherwise(
            F.conv(digits_of, 16, 10).cast("int"))

    touched = F.sequence(number(F.col("lo"), 0), number(F.col("hi"), 16**digits - 1))
    table = ring.select(F.explode(ranges).alias("x")).select("x.*").select(
        F.explode(touched).alias("p"), "lo", "hi", "cluster").select(
        F.lpad(F.lower(F.hex("p")), digits, "0").alias("prefix"), "lo", "hi", "cluster")
    return table, digits


def route(rows: DataFrame, nodes: list[str], key: str = "asset_uuid",
          replicas: int = RING_REPLICAS, out: str = "cluster") -> DataFrame:
    """Add the owning cluster of each row's key. Rows are not shuffled; a NULL key has no owner."""
    ring, digits = hash_ring(rows.sparkSession, nodes, replicas)
    ring = ring.select(F.col("prefix").alias("_p"), "lo", "hi", F.col("cluster").alias(out))
    if len(nodes) * replicas <= BROADCAST_ROWS:
        ring = F.broadcast(ring)
    hashed = rows.withColumn("_h", F.sha2(F.col(key), 256))
    cond = ((F.substring("_h", 1, digits) == F.col("_p"))
            & (F.col("_h") >= F.col("lo")) & (F.col("_h") < F.col("hi")))
    return hashed.join(ring, cond, "left").select(*rows.columns, out)


def ring_reassignment(assets: DataFrame, before: list[str], after: list[str],
                      replicas: int = RING_REPLICAS) -> DataFrame:
    """Assets whose owner changes when the set of clusters changes."""
    both = route(route(assets, before, replicas=replicas, out="old_cluster"), after,
                 replicas=replicas, out="new_cluster")
    return both.where(F.col("old_cluster") != F.col("new_cluster"))


def routing_balance(messages: DataFrame, nodes: list[str],
                    replicas: int = RING_REPLICAS) -> DataFrame:
    """Assets and messages per cluster; messages are counted per asset before routing."""
    per_asset = messages.where(F.col("asset_uuid").isNotNull()).groupBy("asset_uuid").agg(
        F.count("*").alias("n"))
    return route(per_asset, nodes, replicas=replicas).groupBy("cluster").agg(
        F.count("*").alias("assets"), F.sum("n").alias("messages"))
