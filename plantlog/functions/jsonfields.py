"""Case-insensitive field access over JSON objects.

Producers disagree about the case of field names and ``from_json`` with a struct is
case-sensitive, so an object is read as a string map once, its names are folded to lower case, and
the last of several equal names wins. Names and values are kept in reverse order, which makes "the
last one" a plain ``array_position``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAP_DDL = "map<string,string>"

_NAMES, _VALUES = "_names", "_values"


def fold_fields(df: DataFrame, text: str = "value") -> DataFrame:
    """Add the folded fields of a JSON column for :func:`folded_field`; both are NULL when the
    text is no JSON object. Drop them with ``select``."""
    return (df.withColumn("_object", F.from_json(text, MAP_DDL))
            .withColumn(_NAMES, F.reverse(F.transform(F.map_keys("_object"), lambda k: F.lower(k))))
            .withColumn(_VALUES, F.reverse(F.map_values("_object"))))


def is_object() -> Column:
    return F.col(_NAMES).isNotNull()


def folded_contains(name: str) -> Column:
    return F.array_contains(F.col(_NAMES), name.lower())


def folded_field(name: str) -> Column:
    """Value of one field (NULL when absent), the last duplicate winning."""
    position = F.nullif(F.array_position(F.col(_NAMES), name.lower()), F.lit(0))
    return F.try_element_at(F.col(_VALUES), position.cast("int"))


def field_count() -> Column:
    return F.size(_NAMES)


def without_field(text: Column, name: str) -> Column:
    """The object as JSON text with every spelling of one field removed."""
    kept = F.map_filter(
        F.from_json(text, "map<string,variant>"), lambda k, _: F.lower(k) != name.lower())
    return F.to_json(kept)


def with_attributes(text: Column, extra: Column) -> Column:
    """The object as JSON text with the entries of a string map set in its ``attributes`` (the last
    spelling of which counts); all other values keep their types."""
    whole = F.from_json(text, "map<string,variant>")
    is_own = lambda k: F.lower(k) == "attributes"
    own = F.element_at(F.map_values(F.map_filter(whole, lambda k, _: is_own(k))), -1)
    has = F.size(F.map_filter(whole, lambda k, _: is_own(k))) > 0
    kept = F.map_filter(F.from_json(F.when(has, F.to_json(own)), "map<string,variant>"),
                        lambda k, _: ~F.map_contains_key(extra, k))
    added = F.transform_values(extra, lambda _, v: v.cast("variant"))
    all_ = F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,variant>")), added)
    rest = F.map_filter(whole, lambda k, _: ~is_own(k))
    return F.to_json(F.map_concat(rest, F.when(has | (F.size(extra) > 0), F.create_map(
        F.lit("attributes"), F.to_variant_object(all_))).otherwise(
        F.create_map().cast("map<string,variant>"))))
