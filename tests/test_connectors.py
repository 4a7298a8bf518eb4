import json

import pytest
from pyspark.sql import functions as F

from plantlog.operators import connectors as C
from tests.conftest import rows


def parsed(spark, *configs):
    return C.parse_configs(spark.createDataFrame(
        [(f"D{i}", json.dumps(c)) for i, c in enumerate(configs)],
        "asset_uuid string, connector_config string"))


OPCUA = {"type": "opcua", "server": {"uri": "opc.tcp://x", "subscription": {"queue_size": 7}},
         "constants": {"serial": {"node_id": "ns=3;s=Serial", "tag": "SerialNumber"}},
         "variables": {"temp": {"node_id": "ns=3;i=1050", "tag": "Temperature", "deadband": 0.1},
                       "pos": {"browse_path": "0:Root/2:A", "tag": "Pos", "queue_size": 2,
                               "sampling_interval": 10.0}},
         "events": {"ev": {"node_id": "ns=3;i=1"}}, "methods": {"run": {"node_id": "ns=3;i=2"}}}
SHDR = {"uuid": "x", "connector": {"type": "shdr", "host": "h", "port": 7878,
                                   "data": {"x": {"tag": "X", "type": "Samples"}}}}


def test_signals(spark):
    got = rows(C.connector_signals(parsed(spark, OPCUA, SHDR)).select("connector", "section", "name", "tag", "type"))
    assert got == [("opcua", "constants", "serial", "SerialNumber", None), ("opcua", "events", "ev", None, None),
                   ("opcua", "methods", "run", None, None), ("opcua", "variables", "pos", "Pos", None),
                   ("opcua", "variables", "temp", "Temperature", None), ("shdr", "data", "x", "X", "Samples")]


def test_subscription(spark):
    bare = {**OPCUA, "server": {"uri": "u"}}
    got = rows(C.with_subscription(C.connector_signals(parsed(spark, OPCUA, bare))).select(
        "asset_uuid", "name", "queue_size", "sampling_interval", "deadband"))
    assert got == [("D0", "pos", 2, 10.0, 0.0), ("D0", "temp", 7, 0.0, 0.1),
                   ("D1", "pos", 2, 10.0, 0.0), ("D1", "temp", 1, 0.0, 0.1)]


@pytest.mark.parametrize("text, want", [
    ("ns=3;i=1050", (True, 3, "i", "1050")), ("ns=2;s=a=b", (True, 2, "s", "a=b")),
    ("ns=2;x=1", (False, None, None, None)), ("ns=a;i=1", (False, None, None, None)),
    ("ns=1;s=a;b", (False, None, None, None))])
def test_node_id(spark, text, want):
    df = spark.createDataFrame([("D", "variables", "v", text)],
                               "asset_uuid string, section string, name string, node_id string")
    assert tuple(C.parse_node_ids(df).first())[4:] == want


@pytest.mark.parametrize("path, error", [
    ("0:Root/2:A", None), ("0:Root", None), (None, None), ("", None), ("1:Root", "not_from_root"),
    ("0:Root/2A", "no_colon"), ("0:Root/ 2:A", "outer_space"), ("0:Root/2:A ", "outer_space"),
    ("0:Root/2 :A", "space_at_colon"), ("0:Root/2: A", "space_at_colon"), ("0:Root/x:A", "index_not_numeric"),
    ("0:Root/2:", "empty_identifier"), ("0:Root/2:a:b", None), ("0:Root/", "no_colon")])
def test_browse_path(spark, path, error):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(C.browse_path_error(F.col("p"))).first()[0] == error


def test_cross_checks(spark):
    cfg = {**OPCUA, "constants": {"temp": {"node_id": "ns=1;i=1", "tag": "a"}, "b": {"node_id": "ns=1;i=1", "tag": "b"},
                                  "none": {"tag": "c"}, "both": {"node_id": "ns=1;i=9", "browse_path": "0:Root", "tag": "d"}}}
    s = C.connector_signals(parsed(spark, cfg))
    assert rows(C.duplicate_nodes(s)) == [("D0", "constants", "ns=1;i=1", 2, ["b", "temp"])]
    assert rows(C.name_conflicts(s)) == [("D0", "temp", "constants,variables", 2)]
    assert rows(C.node_address_checks(s).where("error IS NOT NULL").select("name", "error")) == [
        ("both", "both"), ("none", "neither")]


@pytest.mark.parametrize("agent, errors", [
    ({"port": 1, "ip": "x"}, (None, None)),
    ({"port": 1, "device_xml": "d", "adapter": {"port": 1, "ip": "a"}}, (None, None)),
    ({"port": 1, "device_xml": "d", "adapter": {"port": 1}}, (None, "ip_xor_image")),
    ({"port": 1, "device_xml": "d", "adapter": {"port": 1, "ip": "a", "image": "b"}}, (None, "ip_xor_image")),
    ({"port": 1, "adapter": {"port": 1, "ip": "a"}}, ("device_xml_missing", None)),
    ({"port": 1, "device_xml": "d"}, ("adapter_missing", None)),
    ({"port": 1, "ip": "x", "adapter": {"port": 1, "ip": "a"}}, ("adapter_not_allowed", None)),
    ({"port": 1, "ip": "x", "device_xml": "d"}, ("device_xml_not_allowed", None))])
def test_mtconnect(spark, agent, errors):
    r = C.mtconnect_checks(parsed(spark, {"type": "mtconnect", "agent": agent})).first()
    assert (r["agent_error"], r["adapter_error"]) == errors


@pytest.mark.parametrize("port, ok", [(1, True), (65535, True), (0, False), (65536, False)])
def test_shdr(spark, port, ok):
    cfg = {"type": "shdr", "host": "h", "port": port, "data": {"a": {"tag": "A", "type": "Condition"}}}
    r = C.shdr_checks(parsed(spark, cfg)).first()
    assert (r["port_ok"], r["bad_types"]) == (ok, 1)
