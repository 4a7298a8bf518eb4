"""Read views over the state tables: asset attributes, listings, lookups, discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantlog import schema as S
from plantlog.functions import clean_tag, samples_numeric
from plantlog.operators.references import reference_list
from plantlog.schema import DEFAULT_VOCABULARY, Vocabulary


def _of_asset(state: DataFrame, asset: str | None, key: str = "asset_uuid") -> DataFrame:
    return state if asset is None else state.where(F.col(key) == asset)


def point_lookup(state: DataFrame, key: str) -> DataFrame:
    return state.where(F.col("key") == key)


def asset_attributes(state: DataFrame, asset: str | None = None,
                     key: str = "asset_uuid") -> DataFrame:
    """Current attributes (methods excluded) with the numeric form of samples."""
    rows = _of_asset(state, asset, key).where(F.col("type") != S.METHOD)
    return rows.withColumn("value_num", samples_numeric(F.col("value"), F.col("type")))


def method_contract(text: Column) -> Column:
    """The contract of a method reading; NULL when the text is not JSON."""
    return F.from_json(text, S.METHOD_CONTRACT)


def asset_methods(state: DataFrame, asset: str | None = None,
                  key: str = "asset_uuid") -> DataFrame:
    """Current methods with their parsed contract; text that is no JSON stays in ``value``."""
    rows = _of_asset(state, asset, key).where(F.col("type") == S.METHOD)
    is_json = F.col("value").isNotNull() & F.try_parse_json("value").isNotNull()
    return rows.withColumn("contract", method_contract(F.col("value"))).withColumn(
        "is_json", is_json)


def method_arguments(methods: DataFrame) -> DataFrame:
    """One row per method argument; a method without arguments keeps one row with a dash."""
    args = F.col("contract.arguments")
    shown = F.when(F.coalesce(F.size(args), F.lit(0)) > 0, F.transform(
        args, lambda a: F.concat_ws(": ", a["name"], a["description"]))).otherwise(
        F.array(F.lit(S.NO_ARGUMENTS)))
    return methods.select("asset_uuid", F.col("id").alias("method"),
                          F.col("contract.description").alias("description"),
                          F.posexplode(shown).alias("pos", "argument"))


def attributes_by_type(state: DataFrame, reading_type: str, asset: str | None = None,
                       key: str = "asset_uuid") -> DataFrame:
    return _of_asset(state, asset, key).where(F.col("type") == reading_type).select(
        key, "id", "value", clean_tag(F.col("tag")).alias("tag"))


def asset_inspect(state: DataFrame, asset: str | None = None,
                  key: str = "asset_uuid") -> DataFrame:
    """Samples, events and conditions of an asset with the type name shown to people."""
    rows = _of_asset(state, asset, key).where(
        F.col("type").isin(S.SAMPLES, S.EVENTS, S.CONDITION))
    return rows.select(
        key, "id", "value",
        F.when(F.col("type") == S.SAMPLES, "Sample").otherwise(F.col("type")).alias("type"),
        clean_tag(F.col("tag")).alias("tag"))


def asset_wide(state: DataFrame, signals: list[str]) -> DataFrame:
    """One row per asset with the chosen signals as columns, UNAVAILABLE where absent."""
    wide = (state.where(F.col("asset_uuid").isNotNull())
            .groupBy("asset_uuid").pivot("id", signals).agg(F.first("value", ignorenulls=True)))
    return wide.na.fill(S.UNAVAILABLE, subset=signals)


# ---- Fleet lookups -----------------------------------------------------------------------

def assets_with_availability(avail: DataFrame, availability: str = S.AVAILABLE) -> DataFrame:
    return avail.where(F.col("availability") == availability).select("asset_uuid")


def assets_of_type(types: DataFrame, asset_type: str | None = None) -> DataFrame:
    """Deployed assets, of one type or of all."""
    rows = types if asset_type is None else types.where(F.col("type") == asset_type)
    return rows.select("asset_uuid", "type")


def distinct_assets(types: DataFrame) -> DataFrame:
    return types.select("asset_uuid").distinct()


def discover_by_type(types: DataFrame, avail: DataFrame, wanted: DataFrame) -> DataFrame:
    """First asset (by uuid) of each wanted service ``type`` and whether it is AVAILABLE.

    A type nobody offers comes out with ``error = 'not_deployed'``, an offered but absent one with
    ``'not_available'``.
    """
    first = types.join(wanted, "type", "left_semi").groupBy("type").agg(
        F.min("asset_uuid").alias("asset_uuid"))
    found = wanted.join(first, "type", "left").join(avail, "asset_uuid", "left")
    return found.select(
        "type", "asset_uuid", "availability",
        F.when(F.col("asset_uuid").isNull(), "not_deployed")
        .when(F.coalesce(F.col("availability"), F.lit("")) != S.AVAILABLE, "not_available")
        .alias("error"))


def asset_by_service(services: DataFrame, requested: DataFrame) -> DataFrame:
    """Asset running each requested ``docker_service``; empty text when there is none."""
    owner = services.groupBy("docker_service").agg(F.min("asset_uuid").alias("_a"))
    return requested.join(owner, "docker_service", "left").select(
        "docker_service", F.coalesce("_a", F.lit("")).alias("asset_uuid"))


def asset_type_lookup(requested: DataFrame, types: DataFrame) -> DataFrame:
    return requested.join(types, "asset_uuid", "left").select(
        "asset_uuid", F.coalesce("type", F.lit(S.UNAVAILABLE)).alias("type"))


# ---- Listings ----------------------------------------------------------------------------

# Signals each listing reads, for a state restricted to them.
ASSET_LISTING_SIGNALS = ["uns_id", "avail", "agent_avail", S.SERVICE_ID]
DEVICE_LISTING_SIGNALS = ["avail", *S.REFERENCE_IDS]
APP_FIELDS = ["application_manufacturer", "application_version", "application_license"]
APP_LISTING_SIGNALS = ["avail", *APP_FIELDS]
AGENT_LISTING_SIGNALS = ["agent_avail", "agent_port"]


def _listed(types: DataFrame, state: DataFrame, signals: list[str]) -> DataFrame:
    """Deployed assets with chosen signals; only those assets' rows are pivoted."""
    deployed = types.select("asset_uuid")
    wanted = state.where(F.col("id").isin(*signals)).join(deployed, "asset_uuid", "left_semi")
    return types.join(asset_wide(wanted, signals), "asset_uuid", "left").na.fill(
        S.UNAVAILABLE, subset=signals)


def asset_listing(types: DataFrame, state: DataFrame) -> DataFrame:
    rows = _listed(types, state, ASSET_LISTING_SIGNALS)
    source = F.when(F.col("type") == S.MTCONNECT_AGENT, F.col("agent_avail")).otherwise(
        F.col("avail"))
    return rows.select("asset_uuid", "uns_id", F.upper(source).alias("availability"), "type",
                       F.col(S.SERVICE_ID).alias("docker_service"))


def device_listing(types: DataFrame, state: DataFrame) -> DataFrame:
    """Devices with the helper of each role found among their references below. The list is searched
    where the device's signals meet; no reference becomes a row."""
    below = S.REFERENCE_IDS[0]
    rows = _listed(types.where(F.col("type") == "Device"), state, ["avail", below])
    names = reference_list(F.col(below))
    helper = {r: F.concat("asset_uuid", F.lit(f"-{r}")) for r in S.DEVICE_ROLES}
    return rows.select("asset_uuid", F.upper("avail").alias("availability"), *[
        F.when(F.array_contains(names, h), h).otherwise(S.NOT_DEPLOYED).alias(r.lower())
        for r, h in helper.items()])


def app_listing(types: DataFrame, state: DataFrame,
                vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    apps = _listed(types.where(F.col("type") == vocab.app_type), state, APP_LISTING_SIGNALS)
    return apps.select("asset_uuid", F.upper("avail").alias("availability"), *APP_FIELDS)


def agent_listing(types: DataFrame, state: DataFrame) -> DataFrame:
    agents = _listed(types.where(F.col("type") == S.MTCONNECT_AGENT), state,
                     AGENT_LISTING_SIGNALS)
    return agents.select("asset_uuid", "agent_avail", "agent_port")


def prometheus_targets(targets: DataFrame) -> DataFrame:
    """Scrape targets in the HTTP service-discovery form."""
    return targets.select(
        "application_uuid",
        F.array(F.concat(F.col("host"), F.lit(":"), F.col("port").cast("string"))).alias("targets"),
        F.create_map(F.lit("__metrics_path__"), F.col("path")).alias("labels"))
