"""All derived streams and tables of one log, registered under their names for ad-hoc SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from plantlog.operators import events as E, state as St, uns
from plantlog.schema import DEFAULT_VOCABULARY, Vocabulary

STREAM, TABLE = "STREAM", "TABLE"


@dataclass
class Catalog:
    """Named streams and tables of a session, with where each comes from."""

    spark: SparkSession
    entries: dict[str, tuple[str, str]] = field(default_factory=dict)

    def register(self, name: str, kind: str, df: DataFrame, source: str = "") -> None:
        df.createOrReplaceTempView(name)
        self.entries[name] = (kind, source)

    def create(self, name: str, kind: str, query: str) -> DataFrame:
        """``CREATE STREAM/TABLE name AS query``."""
        df = self.spark.sql(query)
        self.register(name, kind, df, "query")
        return df

    def drop(self, name: str) -> bool:
        self.entries.pop(name, None)
        return self.spark.catalog.dropTempView(name)

    def query(self, text: str, upper: bool = False) -> DataFrame:
        """One-shot result of a SELECT; ``upper`` gives upper-case column names."""
        df = self.spark.sql(text)
        return df.toDF(*[c.upper() for c in df.columns]) if upper else df

    def listing(self) -> DataFrame:
        """``(name, kind, source)`` of everything registered."""
        rows = [(n, k, s) for n, (k, s) in sorted(self.entries.items())]
        return self.spark.createDataFrame(rows, "name string, kind string, source string")

    def source_of(self, name: str) -> str:
        return self.entries[name][1]


def build_topology(spark: SparkSession, events: DataFrame, map_changelog: DataFrame | None = None,
                   source: str = "", vocab: Vocabulary = DEFAULT_VOCABULARY,
                   connector_changelog: DataFrame | None = None,
                   metrics_changelog: DataFrame | None = None,
                   removals: DataFrame | None = None) -> Catalog:
    """Register every derived stream and table; a query only computes what it names. Changelogs have
    the columns ``k, v, offset``, the name map ``asset_uuid, uns_id, uns_levels, offset, log_time``,
    and ``removals`` (tombstones of deregistered assets) ``asset_uuid, target, log_time``. With a name map,
    registration measures its versions once to choose the plan of ``assets_stream_uns``."""
    catalog = Catalog(spark)
    enriched = E.enrich(events)
    assets = St.latest_state(enriched)
    catalog.register("assets_stream", STREAM, events, source)
    catalog.register("enriched_assets_stream", STREAM, enriched, "assets_stream")
    catalog.register("assets", TABLE, assets, "enriched_assets_stream")
    catalog.register("assets_aggregated_by_asset_uuid", TABLE, St.readings_by_asset(assets),
                     "assets")
    catalog.register("docker_services_stream", STREAM, E.service_changes(events, vocab),
                     "assets_stream")
    catalog.register("docker_services", TABLE, St.docker_services(events, vocab, removals),
                     "docker_services_stream")
    catalog.register("assets_type_stream", STREAM, E.type_changes(events, vocab), "assets_stream")
    catalog.register("assets_type_tombstones", STREAM, E.type_tombstones(events, vocab),
                     "assets_stream")
    catalog.register("assets_type", TABLE, St.assets_type(events, vocab, removals),
                     "assets_type_stream")
    catalog.register("assets_avail_stream", STREAM, E.availability_changes(events),
                     "assets_stream")
    catalog.register("assets_avail_tombstones", STREAM, E.availability_tombstones(events),
                     "assets_stream")
    catalog.register("assets_avail", TABLE, St.assets_avail(events, removals),
                     "assets_avail_stream")
    if map_changelog is not None:
        current = St.uns_map(map_changelog, removals)
        map_changelog = St.with_removals(map_changelog, removals, "asset_to_uns_map")
        catalog.register("asset_to_uns_map_raw", TABLE, map_changelog, "map changelog")
        catalog.register("asset_to_uns_map", TABLE, current, "asset_to_uns_map_raw")
        catalog.register("assets_stream_uns", STREAM,
                         uns.stream_by_uns(events, map_changelog), "assets_stream")
        catalog.register("assets_uns", TABLE, uns.state_by_uns(assets, current), "assets")
    for name, key, changelog in (
            ("device_connector", "asset_uuid", connector_changelog),
            ("metrics_targets", "application_uuid", metrics_changelog)):
        if changelog is not None:
            catalog.register(f"{name}_source", TABLE, changelog, f"{name} changelog")
            catalog.register(name, TABLE, St.changelog_snapshot(changelog).withColumnRenamed(
                "k", key), f"{name}_source")
    return catalog
