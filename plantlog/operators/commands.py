"""Command envelopes: parsing, argument binding, building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantlog import schema as S
from plantlog.functions import broadcast_if_bounded, iso_ms, parse_time
from plantlog.functions.jsonfields import MAP_DDL
from plantlog.schema import DEFAULT_VOCABULARY, Vocabulary

UUID_PATTERN = r"(?i)^(urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"
HEADER_FIELDS = ("correlation_id", "sender_uuid", "timestamp", "signature")

INT_PATTERN = r"^\s*[+-]?\d+(\.0+)?\s*$"
FLOAT_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
TRUE_WORDS = ("true", "1", "yes", "y", "on", "t")
FALSE_WORDS = ("false", "0", "no", "n", "off", "f")


def _only_known(fields: Column, names: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.map_keys(fields), F.array(*[F.lit(n) for n in names]))) == 0


def parse_envelopes(commands: DataFrame, text: str = "value",
                    received_at: Column | None = None) -> DataFrame:
    """Validated envelope columns; ``error`` names the first broken rule, else NULL.

    Unknown fields are refused, surrounding whitespace is dropped, arguments default to none and
    a missing timestamp to ``received_at``.
    """
    df = (commands
          .withColumn("_o", F.from_json(text, "map<string,variant>"))
          .withColumn("_h", F.from_json(F.to_json(F.col("_o")["header"]), "map<string,string>"))
          .withColumn("_a", F.from_json(F.to_json(F.col("_o")["arguments"]), "map<string,variant>")))
    head = F.col("_h")
    stamp = F.trim(head["timestamp"])
    given = F.map_contains_key(head, "timestamp")
    has_args = F.map_contains_key("_o", "arguments")
    all_text = F.forall(F.map_values("_a"), lambda v: F.coalesce(
        F.schema_of_variant(v) == "STRING", F.lit(False)))
    error = (
        F.when(F.col("_o").isNull(), "bad_json")
        .when(~_only_known(F.col("_o"), ("header", "arguments")), "unknown_field")
        .when(head.isNull(), "missing_header")
        .when(~_only_known(head, HEADER_FIELDS), "unknown_header_field")
        .when(~F.coalesce(F.trim(head["correlation_id"]).rlike(UUID_PATTERN), F.lit(False)),
              "bad_correlation_id")
        .when(head["sender_uuid"].isNull(), "missing_sender")
        .when(given & parse_time(stamp).isNull(), "bad_timestamp")
        .when(has_args & F.col("_a").isNull(), "bad_arguments")
        .when(has_args & ~all_text, "argument_not_text"))
    arguments = F.transform_values(
        F.from_json(F.to_json(F.col("_o")["arguments"]), MAP_DDL), lambda _, v: F.trim(v))
    when = F.coalesce(parse_time(stamp), received_at if received_at is not None
                      else F.lit(None).cast("timestamp"))
    ok = F.col("error").isNull()
    return (df.withColumn("error", error)
            .withColumn("correlation_id", F.when(ok, F.lower(F.trim(head["correlation_id"]))))
            .withColumn("sender_uuid", F.when(ok, F.trim(head["sender_uuid"])))
            .withColumn("issued_at", F.when(ok, when))
            .withColumn("signature", F.when(ok, F.trim(head["signature"])))
            .withColumn("arguments", F.when(ok, F.coalesce(
                arguments, F.create_map().cast(MAP_DDL))))
            .drop("_o", "_h", "_a"))


def _bound(param: Column, arguments: Column) -> Column:
    """One declared parameter against the given arguments: ``(name, value, error)``."""
    given = F.map_contains_key(arguments, param["name"])
    raw = arguments[param["name"]]
    kind = param["type"]
    number = F.when(raw.rlike(FLOAT_PATTERN), raw.try_cast("double"))
    whole = F.when(raw.rlike(INT_PATTERN),
                   F.regexp_replace(F.trim(raw), r"\.0+$", "").try_cast("bigint"))
    truth = (F.when(F.lower(raw).isin(*TRUE_WORDS), "true")
             .when(F.lower(raw).isin(*FALSE_WORDS), "false"))
    typed = (F.when(kind == "int", whole.cast("string"))
             .when(kind == "float", number.cast("string"))
             .when(kind == "bool", truth).otherwise(raw))
    value = F.when(given, typed).otherwise(param["default"])
    error = (F.when(given & typed.isNull(), F.concat(F.lit("not_"), kind))
             .when(~given & param["required"], F.lit("missing_required")))
    return F.struct(param["name"].alias("name"), value.alias("value"), error.alias("error"))


def bind_arguments(commands: DataFrame, parameters: DataFrame) -> DataFrame:
    """Bind parsed commands to declared parameters ``(method, pos, name, type, default, required)``.

    Adds ``bound`` (array of name, value, error in declared order) and ``bind_error`` (the first
    one). Parameters are gathered per method once; commands are neither exploded nor regrouped.
    """
    declared = parameters.groupBy("method").agg(F.sort_array(F.collect_list(
        F.struct("pos", "name", "type", "default", "required"))).alias("_params"))
    joined = commands.join(broadcast_if_bounded(declared), "method", "left")
    params = F.coalesce("_params", F.array().cast(declared.schema["_params"].dataType))
    bound = F.transform(params, lambda p: _bound(p, F.col("arguments")))
    errors = F.filter(F.col("bound"), lambda b: b["error"].isNotNull())
    first = F.try_element_at(errors, F.lit(1))
    return joined.withColumn("bound", bound).withColumn(
        "bind_error", F.concat(first["name"], F.lit(":"), first["error"])).drop("_params")


def build_commands(requests: DataFrame, now: Column, correlation_id: Column | None = None,
                   vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Command readings from ``(asset_uuid, method, sender_uuid, arguments)`` requests."""
    header = F.struct(
        (F.uuid() if correlation_id is None else correlation_id).alias("correlation_id"),
        F.col("sender_uuid"), iso_ms(now).alias("timestamp"),
        F.lit(None).cast("string").alias("signature"))
    arguments = F.coalesce("arguments", F.create_map().cast(MAP_DDL))
    envelope = F.to_json(F.struct(header.alias("header"), arguments.alias("arguments")),
                         {"ignoreNullFields": "false"})
    return requests.select(
        "asset_uuid", F.concat("method", F.lit(S.COMMAND_SUFFIX)).alias("id"),
        envelope.alias("value"), F.lit(vocab.platform_type).alias("type"),
        F.lit(S.COMMAND_TAG).alias("tag"), iso_ms(now).alias("timestamp"))


def command_readings(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Readings that are commands, with the ``method`` they call."""
    return events.where(F.col("id").endswith(S.COMMAND_SUFFIX)
                        & (F.col("type") == vocab.platform_type)).withColumn(
        "method", F.regexp_replace("id", f"{S.COMMAND_SUFFIX}$", ""))


def execute_commands(events: DataFrame, parameters: DataFrame,
                     vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Every command with its outcome: ``error`` NULL means it can run with ``bound``.

    A bad envelope or argument is a value in ``error``; it never stops the others.
    """
    parsed = parse_envelopes(command_readings(events, vocab))
    bound = bind_arguments(parsed, parameters)
    return bound.withColumn("error", F.coalesce(
        "error", F.when(F.col("error").isNull(), F.col("bind_error")))).drop("bind_error")
