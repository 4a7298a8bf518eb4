from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from plantlog import functions as fn
from plantlog.functions.jsonfields import folded_contains, without_field
from plantlog.operators import events as E
from plantlog.schema import RAW_RECORD, Vocabulary
from plantlog.sources import as_records, from_position, parse_asset_events, parse_changelog
from tests.conftest import rows


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(
        expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text, number", [
    ("42.5", 42.5), (" 7 ", 7.0), ("1e3", 1000.0), ("-.5", -0.5), ("val1", None), ("4.5d", None),
    ("1_0", None), ("", None), (None, None)])
def test_numeric(spark, text, number):
    df = spark.createDataFrame([(text, "Samples")], "value string, type string")
    assert E.with_numeric(df).first()["value_num"] == number


def test_only_samples_are_numbers(spark):
    df = spark.createDataFrame([("42.5", "Events")], "value string, type string")
    assert E.with_numeric(df).first()["value_num"] is None


@pytest.mark.parametrize("tag, clean", [
    ("{urn:mtconnect.org:MTConnectStreams:2.2}MockedTag", "MockedTag"), ("{a}X{b} ", "X"),
    ("Plain", "Plain"), (None, None)])
def test_clean_tag(spark, tag, clean):
    df = spark.createDataFrame([(tag,)], "tag string")
    assert df.select(fn.clean_tag(F.col("tag")).alias("t")).first()["t"] == clean


def test_keys_and_subjects(spark):
    df = spark.createDataFrame([("A", "x.y"), (None, "i"), ("B", None)], "asset_uuid string, id string")
    assert [r[0] for r in df.select(fn.composite_key()).collect()] == ["A|x.y", None, None]
    assert one(spark, fn.subject_signal(F.col("s")), s="A.x.y") == "x.y"


def test_times(spark):
    t = datetime(2025, 5, 4, 12, 34, 56, 789999)
    df = spark.createDataFrame([(t,)], "ts timestamp_ntz")
    r = df.select(fn.iso_ms(F.col("ts")).alias("a"), fn.epoch_millis(F.col("ts")).alias("b")).first()
    assert r["a"] == "2025-05-04T12:34:56.789Z"
    assert r["b"] == int(t.replace(tzinfo=timezone.utc).timestamp() * 1000)


def test_case_insensitive_fields(spark):
    text = '{"ID":"first","Value":1,"iD":"last"}'
    df = fn.fold_fields(spark.createDataFrame([(text,)], "s string"), "s")
    assert tuple(df.select(fn.folded_field("id"), fn.folded_field("VALUE"), fn.folded_field("tag"),
                           folded_contains("vAlUe"), folded_contains("tag")).first()) == (
        "last", "1", None, True, False)
    assert one(spark, without_field(F.col("s"), "id"), s=text) == '{"Value":1}'


def records(spark, *pairs):
    data = [(k, v, 0, i, datetime(2023, 11, 14, 22, 13, 20), i % 3) for i, (k, v) in enumerate(pairs)]
    return spark.createDataFrame(data, RAW_RECORD)


def test_invalid_messages(spark):
    raw = records(spark, ("A", '{"ID":"x","VALUE":1}'), ("A", '{"Id":"y"}'), ("A", '{"id":""}'),
                  ("A", '{"id":null}'), ("A", "{}"), (None, '{"id":"z"}'), ("A", "{broken"),
                  ("A", None), ("A", "[1]"))
    good, dead = E.split_invalid(parse_asset_events(raw, keep_payload=True))
    assert rows(good.select("offset", "id")) == [(0, "x"), (1, "y")]
    assert rows(dead.select("offset", "error")) == [
        (2, "missing_id"), (3, "missing_id"), (4, "missing_id"), (5, "missing_key"),
        (6, "bad_json"), (7, "null_payload"), (8, "bad_json")]


def test_delivery_timestamps(spark):
    df = spark.createDataFrame(
        [(0, {"timestamp": "t", "kafka_timestamp": "old"}, 0), (1, None, 1), (2, {"a": "b"}, 999),
         (3, {"kafka_timestamp": "kept"}, -1)], "offset long, attributes map<string,string>, log_time_type int")
    df = df.withColumn("log_time", F.when(F.col("offset") < 3, F.timestamp_millis(F.lit(1700000000000))))
    out = {r["offset"]: r["attributes"] for r in E.delivery_timestamps(
        df, F.timestamp_millis(F.lit(1700000000123))).collect()}
    at = "2023-11-14T22:13:20.000Z"
    assert out[0] == {"timestamp": "t", "asset_forwarder_timestamp": "2023-11-14T22:13:20.123Z",
                      "kafka_timestamp": at, "kafka_timestamp_type": "producer"}
    assert out[1]["kafka_timestamp_type"] == "broker"
    assert out[2]["kafka_timestamp_type"] == "unknown" and out[2]["a"] == "b"
    assert out[3] == {"kafka_timestamp": "kept",
                      "asset_forwarder_timestamp": "2023-11-14T22:13:20.123Z"}


def test_record_form(spark):
    df = spark.createDataFrame([("A", "x", None, "T", "Samples", "now")],
                               "asset_uuid string, id string, value string, tag string, type string, timestamp string")
    r = as_records(df, F.create_map(F.lit("timestamp"), F.lit("later"), F.lit("q"), F.lit("1"))).first()
    assert r["key"] == "A"
    assert r["value"] == ('{"ID":"x","VALUE":null,"TAG":"T","TYPE":"Samples",'
                          '"attributes":{"timestamp":"later","q":"1"}}')


def test_changelog_parsing(spark):
    raw = records(spark, ("A", '{"HOST":"h","port":"4000","Path":"/m"}'), ("B", None),
                  ("C", '{"host":"h","port":"n/a"}'))
    log = parse_changelog(raw, {"host": "string", "port": "int", "path": "string"})
    assert rows(log.select("k", "v.port", F.col("v").isNull())) == [
        ("A", 4000, False), ("B", None, True), ("C", None, False)]
    assert from_position(raw, 2).count() == 1 and from_position(raw, "latest").count() == 0


def test_own_platform_type(spark):
    vocab = Vocabulary(platform_type="Acme", app_type="AcmeApp")
    df = spark.createDataFrame(
        [("A", "AssetType", "AcmeApp", "Acme", 0), ("B", "AssetType", "AcmeApp", "Platform", 1)],
        "asset_uuid string, id string, value string, type string, offset long")
    assert rows(E.type_changes(df, vocab)) == [("A", "AcmeApp", 0)]


def test_consumer_filter(spark):
    df = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "1")], "asset_uuid string, value string")
    assert E.for_consumer(df, "A", predicate=F.col("value") == "1").count() == 1
    assert E.for_consumer(df, transform=lambda d: d.where("value = '1'")).count() == 2


def test_malformed_changelog_record_keeps_its_key(spark):
    from plantlog.operators.state import changelog_snapshot
    from plantlog.sources import changelog_errors, parse_changelog
    log = spark.createDataFrame([("k", '{"X":"1"}', 1), ("k", "{broken", 2), ("g", '{"x":"2"}', 3), ("g", None, 4),
                                 ("n", "null", 5), ("l", "[1]", 6)], "key string, value string, offset long")
    assert rows(changelog_snapshot(parse_changelog(log, {"x": "string"}))) == [("k", "1")]
    assert rows(changelog_errors(log).select("k", "offset")) == [("k", 2), ("l", 6), ("n", 5)]


def test_positions(spark):
    import pytest
    from plantlog.sources import from_position, starting_offsets
    log = spark.createDataFrame([(0, 5), (0, 9), (1, 2), (2, 1)], "partition int, offset long")
    assert rows(from_position(log, {0: 9, 1: 3})) == [(0, 9), (2, 1)]
    assert starting_offsets("t", {1: 7, 0: 3}, False) == '{"t": {"0": 3, "1": 7}}'
    assert starting_offsets("t", "latest", True) == "latest"
    for start, streaming in (("latest", False), (500, True)):
        with pytest.raises(ValueError):
            starting_offsets("t", start, streaming)


def test_broadcast_bound_counts_bytes(spark):
    from plantlog.functions.sizing import bounded_rows
    wide = spark.range(100).selectExpr("id", "repeat('x', 1000) AS text")
    assert bounded_rows(wide) and not bounded_rows(wide, max_bytes=50_000) and not bounded_rows(wide, limit=99)
