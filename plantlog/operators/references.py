"""Asset-to-asset references: comma lists in the state, edges in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantlog import schema as S


def reference_list(text: Column) -> Column:
    """Trimmed entries of a comma list; a blank list has none."""
    entries = F.transform(F.split(text, ","), lambda r: F.trim(r))
    return F.when(F.trim(text) != "", entries).otherwise(F.array().cast("array<string>"))


def reference_edges(state: DataFrame, key: str = "asset_uuid") -> DataFrame:
    """``(src, direction, pos, dst)`` from the reference signals of a state table.

    ``key="uns_id"`` reads the edges of a state keyed by name.
    """
    refs = state.where(F.col("id").isin(*S.REFERENCE_IDS))
    return refs.select(
        F.col(key).alias("src"),
        F.regexp_replace("id", "^references_", "").alias("direction"),
        F.posexplode(reference_list(F.col("value"))).alias("pos", "dst"))


def reference_lists(edges: DataFrame) -> DataFrame:
    """Edges back to comma lists, one per (src, direction), in list order."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "dst")))
    return edges.groupBy("src", "direction").agg(
        F.array_join(F.transform(ordered, lambda e: e["dst"]), ", ").alias("value"))


def add_reference(current: Column, new: Column) -> Column:
    """The list with a new reference in front."""
    return F.when(F.coalesce(F.trim(current), F.lit("")) == "", new).otherwise(
        F.concat(new, F.lit(", "), F.trim(current)))


def add_references(state: DataFrame, additions: DataFrame) -> DataFrame:
    """New list per (asset_uuid, direction, new_reference) row against the stored lists."""
    stored = state.where(F.col("id").isin(*S.REFERENCE_IDS)).select(
        "asset_uuid", F.regexp_replace("id", "^references_", "").alias("direction"),
        F.col("value").alias("_current"))
    return additions.join(stored, ["asset_uuid", "direction"], "left").select(
        "asset_uuid", "direction",
        add_reference(F.col("_current"), F.col("new_reference")).alias("value"))


def neighbors(edges: DataFrame, direction: str | None = None) -> DataFrame:
    out = edges if direction is None else edges.where(F.col("direction") == direction)
    return out.select(F.col("src").alias("asset_uuid"), "direction", F.col("dst").alias("neighbor"))


def neighbor_state(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Referenced assets with their own signals (referenced assets without state drop out)."""
    own = state.select(F.col("asset_uuid").alias("neighbor"), "id", "value", "type")
    return neighbors(edges).join(own, "neighbor")
