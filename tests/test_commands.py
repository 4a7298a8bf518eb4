import json

import pytest
from pyspark.sql import functions as F

from plantlog.operators import commands as C
from tests.conftest import rows

UID = "12345678-1234-1234-1234-1234567890AB"
HEADER = {"correlation_id": UID, "sender_uuid": " S ", "timestamp": "2024-01-01T00:00:00Z"}


def parse(spark, text):
    df = spark.createDataFrame([(text,)], "value string")
    return C.parse_envelopes(df, received_at=F.lit("2030-01-01").cast("timestamp")).first()


def envelope(header=HEADER, **rest):
    return json.dumps({"header": header, **rest})


@pytest.mark.parametrize("text, error", [
    (envelope(), None), (envelope(arguments={"a": "1"}), None), ("{", "bad_json"), (None, "bad_json"),
    (envelope(extra=1), "unknown_field"), ("{}", "missing_header"),
    (envelope({**HEADER, "role": "x"}), "unknown_header_field"),
    (envelope({**HEADER, "correlation_id": "nope"}), "bad_correlation_id"),
    (envelope({"correlation_id": UID}), "missing_sender"),
    (envelope({**HEADER, "timestamp": "soon"}), "bad_timestamp"),
    (envelope(arguments={"a": 1}), "argument_not_text"), (envelope(arguments=[1]), "bad_arguments"),
    (envelope({**HEADER, "signature": None}), None)])
def test_envelope_rules(spark, text, error):
    assert parse(spark, text)["error"] == error


def test_envelope_values(spark):
    r = parse(spark, envelope({"correlation_id": UID.replace("-", ""), "sender_uuid": " S "},
                              arguments={"a": " 1 "}))
    assert (r["error"], r["sender_uuid"], r["arguments"]) == (None, "S", {"a": "1"})
    assert r["issued_at"].year == 2030
    assert parse(spark, envelope())["arguments"] == {}


PARAMS = [("m", 0, "i", "int", None, True), ("m", 1, "f", "float", "1.5", False),
          ("m", 2, "b", "bool", "false", False), ("m", 3, "s", "str", None, False)]


@pytest.mark.parametrize("args, values, error", [
    ({"i": "11", "f": "2.5", "b": "true", "s": "x"}, ["11", "2.5", "true", "x"], None),
    ({"i": "11.0"}, ["11", "1.5", "false", None], None),
    ({"i": "abc"}, [None, "1.5", "false", None], "i:not_int"),
    ({"i": "1.5"}, [None, "1.5", "false", None], "i:not_int"),
    ({"i": "1", "b": "NO"}, ["1", "1.5", "false", None], None),
    ({"i": "1", "b": "maybe"}, ["1", "1.5", None, None], "b:not_bool"),
    ({"f": "1"}, [None, "1.0", "false", None], "i:missing_required"),
    ({"i": "1", "unknown": "x"}, ["1", "1.5", "false", None], None)])
def test_binding(spark, args, values, error):
    cmd = spark.createDataFrame([("m", args)], "method string, arguments map<string,string>")
    spec = spark.createDataFrame(
        PARAMS, "method string, pos int, name string, type string, default string, required boolean")
    r = C.bind_arguments(cmd, spec).first()
    assert [b["value"] for b in r["bound"]] == values
    assert r["bind_error"] == error


def test_round_trip(spark):
    req = spark.createDataFrame([("A", "move", "S", {"x": "1"}), ("A", "stop", "S", None)],
                                "asset_uuid string, method string, sender_uuid string, arguments map<string,string>")
    made = C.build_commands(req, F.lit("2024-01-01").cast("timestamp"))
    assert rows(made.select("id", "type", "tag").distinct()) == [
        ("move_CMD", "Platform", "Method.Command"), ("stop_CMD", "Platform", "Method.Command")]
    parsed = C.parse_envelopes(C.command_readings(made))
    assert rows(parsed.select("method", "error", "arguments")) == [
        ("move", None, {"x": "1"}), ("stop", None, {})]
    assert parsed.select("correlation_id").distinct().count() == 2


def test_failures_do_not_stop_others(spark):
    ev = spark.createDataFrame(
        [("A", "m_CMD", "{", "Platform"), ("A", "m_CMD", envelope(arguments={"i": "1"}), "Platform"),
         ("A", "m_CMD", envelope(), "Platform"), ("A", "other", "{", "Platform"),
         ("A", "m_CMD", "{", "Events")], "asset_uuid string, id string, value string, type string")
    spec = spark.createDataFrame(
        PARAMS, "method string, pos int, name string, type string, default string, required boolean")
    assert rows(C.execute_commands(ev, spec).select("error")) == [
        ("bad_json",), ("i:missing_required",), (None,)]
