"""Hierarchical names (unified namespace): validation, paths, re-keying, roll-ups."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plantlog.functions import asof_join, broadcast_if_bounded, log_micros
from plantlog.functions.ordered import UNTIMED, version_intervals

ANY = "ANY"


@dataclass(frozen=True)
class Namespace:
    """Ordered levels with their constraint (a constant, ``ANY`` or a list) and a path template."""

    levels: dict[str, str | list[str]]
    template: str
    separator: str = field(init=False)
    fields: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        # A template is a way through the declared levels, in their order, down to the attribute.
        marks = re.findall(r"\W", self.template)
        *path, leaf = self.template.split(marks[0]) if marks else ["", ""]
        ahead = iter(self.levels)
        if leaf != "attribute" or not all(step in ahead for step in [*path, leaf]):
            raise ValueError(f"{self.template!r} is no path through {list(self.levels)} to 'attribute'")
        object.__setattr__(self, "separator", marks[0])
        object.__setattr__(self, "fields", tuple(path))

    def constant(self, name: str) -> str | None:
        rule = self.levels[name]
        return rule if isinstance(rule, str) and rule != ANY else None

    @property
    def free(self) -> list[str]:
        return [n for n in self.fields if self.constant(n) is None]


def _provided(name: str) -> Column:
    return F.col("levels")[name]


def _level(ns: Namespace, name: str) -> Column:
    """Resolved value of one template level (NULL when the asset leaves it out)."""
    fixed = ns.constant(name)
    if fixed is not None:
        return F.lit(fixed)
    own = _provided(name)
    return F.coalesce(own, F.col("asset_uuid")) if name == "asset" else own


def resolved_levels(ns: Namespace) -> Column:
    """Map of every level the name uses; ``asset`` defaults to the asset's uuid."""
    names = list(ns.fields) + ([] if "asset" in ns.fields else ["asset"])
    values = [_level(ns, n) if n in ns.fields else F.col("asset_uuid") for n in names]
    full = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*values))
    return F.map_filter(full, lambda _, v: v.isNotNull())


def constant_violation(ns: Namespace) -> Column:
    """First constant level given with another value, else NULL."""
    checks = [F.when(_provided(n) != ns.constant(n), F.lit(n))
              for n in ns.fields if ns.constant(n) is not None]
    return F.coalesce(*checks, F.lit(None).cast("string"))


def prefix_violation(ns: Namespace) -> Column:
    """``last_not_asset`` when a level below the asset is given with it; ``gap`` when a level is given
    below one that is not. The last place of the name belongs to the asset."""
    free = ns.free
    has = [_provided(n).isNotNull() for n in free]
    none = F.lit(False)
    below, holes = none, none
    if "asset" in free:
        at = free.index("asset")
        below = has[at] & reduce(or_, has[at + 1:], none)
    for upper, lower in zip(has[:-2], has[1:-1]):
        holes = holes | (~upper & lower)
    if free and free[-1] != "asset":
        holes = holes | has[-1]
    return F.when(below, "last_not_asset").when(holes, "gap")


def enum_violation(ns: Namespace) -> Column:
    """First level whose value is not in its list, else NULL."""
    checks = [F.when(_provided(n).isNotNull() & ~_provided(n).isin(*rule), F.lit(n))
              for n, rule in ns.levels.items() if n in ns.fields and isinstance(rule, list)]
    return F.coalesce(*checks, F.lit(None).cast("string"))


def uns_path(ns: Namespace) -> Column:
    """Present levels in template order, joined by the template's separator."""
    return F.concat_ws(ns.separator, *[_level(ns, n) for n in ns.fields])


def attach_uns(assets: DataFrame, ns: Namespace) -> DataFrame:
    """Add ``uns_levels``, ``uns_id`` and ``error``; an invalid asset gets only the error."""
    error = (F.when(constant_violation(ns).isNotNull(),
                    F.concat(F.lit("constant:"), constant_violation(ns)))
             .when(prefix_violation(ns).isNotNull(), prefix_violation(ns))
             .when(enum_violation(ns).isNotNull(), F.concat(F.lit("enum:"), enum_violation(ns))))
    valid = F.col("error").isNull()
    return (assets.withColumn("error", error)
            .withColumn("uns_levels", F.when(valid, resolved_levels(ns)))
            .withColumn("uns_id", F.when(valid, uns_path(ns))))


def duplicate_uuids(devices: DataFrame) -> DataFrame:
    """Uuids claimed by several devices, with all claimants' names in order. The array is bounded by
    the claims of one uuid."""
    return devices.groupBy("uuid").agg(
        F.count("*").alias("claims"), F.sort_array(F.collect_list("name")).alias("names")).where(
        F.col("claims") > 1)


# ---- Re-keying by name -------------------------------------------------------------------

#: One task orders at most the readings of one asset in so many microseconds.
BUCKET_MICROS = 60_000_000


def _mappings(map_changelog: DataFrame) -> DataFrame:
    """Mappings at their place in log time, ``(asset_uuid, _at, uns_id)``. Of several mappings of an asset at one
    time the last by offset counts; one without an offset is not in the log yet and comes after those in it."""
    last = F.struct(F.col("offset").isNull(), F.col("offset"))
    return (map_changelog.where(F.col("asset_uuid").isNotNull())
            .groupBy("asset_uuid", log_micros().alias("_at"))
            .agg(F.max_by(F.struct("uns_id"), last)["uns_id"].alias("uns_id")))


def stream_by_uns(events: DataFrame, map_changelog: DataFrame, strategy: str = "auto",
                  bucket_width: int = BUCKET_MICROS) -> DataFrame:
    """Each reading under the name its asset had when the reading arrived; unmapped ones drop.

    Readings and mappings are two logs: their ``log_time`` orders them, a mapping at a reading's time
    applies to it, and offsets only decide between mappings of an asset at one time. Records
    without a log time stand before all others. The frame is not shuffled by ``uns_id`` here: a
    keyed sink or aggregation does that itself.
    """
    joined = asof_join(events.withColumn("_at", log_micros()), _mappings(map_changelog),
                       ["asset_uuid"], "_at", ["uns_id"], strategy=strategy, bucket_width=bucket_width)
    return joined.where(F.col("uns_id").isNotNull()).drop("_at")


def state_by_uns(state: DataFrame, current_map: DataFrame) -> DataFrame:
    """State under today's names: key ``uns_id|id``; a changed map applies to old rows too."""
    named = current_map.where(F.col("uns_id").isNotNull()).select("asset_uuid", "uns_id")
    return state.join(broadcast_if_bounded(named), "asset_uuid").select(
        F.concat("uns_id", F.lit("|"), "id").alias("key"), F.col("key").alias("asset_uuid_key"),
        "uns_id", "asset_uuid", "id", "value", "type", "tag", "timestamp")


def resolve_uns(requested: DataFrame, map_changelog: DataFrame) -> DataFrame:
    """Asset behind each requested ``uns_id`` with how many assets carry that name now.

    An asset's last mapping is its last by offset; between assets, whose mappings may lie in different
    partitions, the later log time wins (ties: the larger uuid). A name nobody carries gives a NULL
    asset and 0.
    """
    current = map_changelog.groupBy("asset_uuid").agg(
        F.max_by(F.struct("uns_id", log_micros().alias("_at")), "offset").alias("_m")).select(
        "asset_uuid", "_m.*")
    owners = current.where(F.col("uns_id").isNotNull()).groupBy("uns_id").agg(
        F.max_by("asset_uuid", F.struct("_at", "asset_uuid")).alias("asset_uuid"),
        F.count("*").alias("claims"))
    return requested.join(owners, "uns_id", "left").select(
        "uns_id", "asset_uuid", F.coalesce("claims", F.lit(0)).cast("bigint").alias("claims"))


def remap_changes(map_changelog: DataFrame) -> DataFrame:
    """Moments at which a name starts to point to another asset, by the rule of :func:`resolve_uns`.

    A mapping holds its name from its log time to the asset's next mapping, so a name also moves when
    its owner is unmapped or renamed. Starts and ends of all mappings are walked per name in order of
    log time; a task keeps only the mappings in force, so a name's history streams through whatever its
    length. A name that nobody holds for a while moves from its last owner. ``log_time`` is NULL for
    mappings without one.
    """
    held = version_intervals(_mappings(map_changelog), ["asset_uuid"], "_at", ["uns_id"]).where(
        F.col("uns_id").isNotNull())
    events = held.select("uns_id", "asset_uuid", F.explode(F.array(
        F.struct(F.col("_from").alias("at"), F.lit(True).alias("on"), F.col("_from").alias("since")),
        F.struct(F.col("_to").alias("at"), F.lit(False).alias("on"), F.col("_from").alias("since"))
    )).alias("e")).select("uns_id", "asset_uuid", "e.*").where(F.col("at") < 2**63 - 1)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, owner, at, heap, gone = None, None, None, [], set()

        def settle() -> tuple | None:
            """The owner after all changes at one time."""
            nonlocal owner
            while heap and heap[0] in gone:
                gone.discard(heapq.heappop(heap))
            top = heap[0][1].text if heap else None
            before, owner = owner, top or owner
            return (name, owner, at, before) if before and owner != before else None

        for batch in batches:
            out = []
            for uns_id, asset, time, on, since in batch[
                    ["uns_id", "asset_uuid", "at", "on", "since"]].itertuples(index=False):
                if (uns_id, time) != (name, at):
                    out.append(settle())
                    if uns_id != name:
                        owner, heap, gone = None, [], set()
                    name, at = uns_id, time
                entry = (-since, _Last(asset))
                if on:
                    heapq.heappush(heap, entry)
                else:
                    gone.add(entry)
            yield pd.DataFrame([r for r in out if r], columns=_REMAP)
        yield pd.DataFrame([r for r in [settle()] if r], columns=_REMAP)

    moved = events.repartition("uns_id").sortWithinPartitions("uns_id", "at", "on").mapInPandas(
        walk, "uns_id string, asset_uuid string, at long, previous_asset string")
    return moved.select("uns_id", "asset_uuid", F.when(
        F.col("at") != UNTIMED, F.timestamp_micros("at")).alias("log_time"), "previous_asset")


_REMAP = ["uns_id", "asset_uuid", "at", "previous_asset"]


@dataclass(frozen=True)
class _Last:
    """Orders texts backwards."""

    text: str

    def __lt__(self, other: _Last) -> bool:
        return self.text > other.text


def uns_rollup(state: DataFrame, current_map: DataFrame, levels: list[str]) -> DataFrame:
    """Live signals and assets per prefix of the hierarchy, the grand total included.

    Signals are counted per asset before they meet the name map, so the join and the roll-up
    see one row per asset.
    """
    per_asset = state.groupBy("asset_uuid").agg(F.count("*").alias("_signals"))
    named = current_map.where(F.col("uns_id").isNotNull()).select(
        "asset_uuid", *[F.col("uns_levels")[n].alias(n) for n in levels])
    rows = per_asset.join(named, "asset_uuid")
    return rows.rollup(*levels).agg(
        F.sum("_signals").alias("signals"), F.count("*").alias("assets"))
