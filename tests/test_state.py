import json
import random

import pytest
from pyspark.sql import functions as F

from plantlog.operators import references as Ref, registration as R, state as St, views as Vw
from tests.conftest import rows

DDL = ("key string, asset_uuid string, id string, value string, type string, tag string, "
       "timestamp string, partition int, offset long")


def log(spark, *readings):
    return spark.createDataFrame(
        [(f"{a}|{i}", a, i, v, t, g, ts, 0, o) for o, (a, i, v, t, g, ts) in enumerate(readings)], DDL)


@pytest.mark.parametrize("strategy", ["single_pass", "two_pass"])
def test_null_keeps_previous_value_per_column(spark, strategy):
    df = log(spark, ("A", "x", "1", "Samples", "T", "t0"), ("A", "x", None, None, "U", "t1"),
             ("A", "y", None, "Events", None, "t2"))
    got = rows(St.latest_state(df, strategy=strategy).drop("key"))
    assert got == [("A", "x", "1", "Samples", "U", "t1"), ("A", "y", None, "Events", None, "t2")]
    last = rows(St.latest_state(df, ignore_nulls=False, strategy=strategy).drop("key"))
    assert last[0] == ("A", "x", None, None, "U", "t1")


def test_strategies_agree_on_a_hot_key(spark):
    rnd = random.Random(3)
    readings = [("HOT" if rnd.random() < .4 else f"A{rnd.randrange(30)}", f"s{rnd.randrange(3)}",
                 rnd.choice([None, str(o)]), rnd.choice([None, "Samples"]), None, f"t{o}")
                for o in range(2000)]
    df = log(spark, *readings).repartition(7)
    expected = {}
    for a, i, v, t, g, ts in readings:
        old = expected.get((a, i), (None, None))
        expected[a, i] = (v or old[0], t or old[1], ts)
    want = sorted([(a, i, v, t, ts) for (a, i), (v, t, ts) in expected.items()], key=repr)
    for s in ("single_pass", "two_pass"):
        got = rows(St.latest_state(df, strategy=s).select("asset_uuid", "id", "value", "type", "timestamp"))
        assert got == want


def test_rollup_holds_one_element_per_signal(spark):
    df = log(spark, *[("A", f"s{o % 2}", str(o), "Samples", "T", "t") for o in range(50)])
    r = St.readings_by_asset(St.latest_state(df)).first()
    assert [(x["id"], x["value"]) for x in r["readings"]] == [("s0", "48"), ("s1", "49")]


def test_changelog_tombstones(spark):
    df = spark.createDataFrame(
        [("A", (1,), 0), ("A", None, 1), ("B", None, 2), ("B", (2,), 3), ("C", (3,), 4)],
        "k string, v struct<n:int>, offset long")
    assert rows(St.changelog_snapshot(df)) == [("B", 2), ("C", 3)]


def events(spark, *readings):
    return spark.createDataFrame([(*r, o) for o, r in enumerate(readings)],
                                 "asset_uuid string, id string, value string, type string, offset long")


def test_type_and_availability_deletes(spark):
    ev = events(spark, ("A", "AssetType", "Device", "Platform"), ("A", "AssetType", "delete", "Platform"),
                ("B", "AssetType", "Device", "Platform"), ("B", "AssetType", "App", "Events"),
                ("A", "avail", "AVAILABLE", "Events"), ("A", "agent_avail", "UNAVAILABLE", "Events"),
                ("B", "avail", "AVAILABLE", "Events"), ("B", "avail", None, "Events"),
                ("C", "avail", "AVAILABLE", "Events"), ("C", "avail", "delete", "Events"),
                ("A", "DockerService", "svc", "Platform"))
    assert rows(St.assets_type(ev)) == [("B", "Device")]
    assert rows(St.assets_avail(ev)) == [("A", "UNAVAILABLE"), ("B", "AVAILABLE")]
    assert rows(St.docker_services(ev)) == [("A", "svc")]


def test_late_reading_by_timestamp(spark):
    df = log(spark, ("A", "x", "new", "Samples", "T", "2024-01-02T00:00:00.000Z"),
             ("A", "x", "late", "Samples", "T", "2024-01-01T00:00:00.000Z"),
             ("A", "x", "untimed", "Samples", "T", "UNAVAILABLE"))
    assert St.latest_by_timestamp(df).first()["value"] == "new"
    assert St.latest_state(df).first()["value"] == "untimed"
    assert St.state_as_of(df, offset=1).first()["value"] == "late"
    assert St.state_as_of(df, offset={0: 0}).first()["value"] == "new"


def test_resync_keeps_unknown_entries(spark):
    cache = spark.createDataFrame([("x", "1"), ("y", "2")], "id string, value string")
    snap = spark.createDataFrame([("y", None), ("z", "3")], "id string, value string")
    assert rows(St.merge_resync(cache, snap, ["id"])) == [("x", "1"), ("y", None), ("z", "3")]


def test_references(spark):
    ddl = "key string, asset_uuid string, id string, value string"
    state = spark.createDataFrame(
        [("k", "asset-001", "references_above", "existing-ref1, existing-ref2"),
         ("k", "asset-002", "references_below", "  ")], ddl)
    edges = Ref.reference_edges(state)
    assert rows(edges) == [("asset-001", "above", 0, "existing-ref1"),
                           ("asset-001", "above", 1, "existing-ref2")]
    new = spark.createDataFrame([("asset-001", "above", "new-ref"), ("asset-002", "below", "b"),
                                 ("asset-003", "below", "c")],
                                "asset_uuid string, direction string, new_reference string")
    assert rows(Ref.add_references(state, new).select("asset_uuid", "value")) == [
        ("asset-001", "new-ref, existing-ref1, existing-ref2"), ("asset-002", "b"), ("asset-003", "c")]
    assert rows(Ref.reference_lists(edges)) == [("asset-001", "above", "existing-ref1, existing-ref2")]


def test_methods(spark):
    state = spark.createDataFrame(
        [("A", "GenerateCode", '{"description":"GenerateCode","arguments":[]}', "Method"),
         ("A", "Move", '{"description":"m","arguments":[{"name":"x","description":"pos"},{"name":"y","description":""}]}', "Method"),
         ("A", "Raw", "not json", "Method"), ("A", "None", None, "Method"), ("A", "t", "1", "Samples")],
        "asset_uuid string, id string, value string, type string")
    m = Vw.asset_methods(state, "A")
    assert rows(m.select("id", "is_json", F.col("contract.description"))) == [
        ("GenerateCode", True, "GenerateCode"), ("Move", True, "m"), ("None", False, None),
        ("Raw", False, None)]
    args = Vw.method_arguments(m).select("method", "argument")
    assert rows(args) == [("GenerateCode", "—"), ("Move", "x: pos"), ("Move", "y: "), ("None", "—"), ("Raw", "—")]


def test_wide_view_and_listings(spark):
    types = spark.createDataFrame([("D", "Device"), ("G", "MTConnectAgent"), ("P", "PlatformApp")],
                                  "asset_uuid string, type string")
    state = spark.createDataFrame(
        [("D", "avail", "available"), ("D", "references_below", "D-AGENT, X-PRODUCER"),
         ("G", "agent_avail", "AVAILABLE"), ("G", "agent_port", "5000"), ("Z", "avail", "AVAILABLE")],
        "asset_uuid string, id string, value string")
    assert rows(Vw.asset_listing(types, state)) == [
        ("D", "UNAVAILABLE", "AVAILABLE", "Device", "UNAVAILABLE"),
        ("G", "UNAVAILABLE", "AVAILABLE", "MTConnectAgent", "UNAVAILABLE"),
        ("P", "UNAVAILABLE", "UNAVAILABLE", "PlatformApp", "UNAVAILABLE")]
    assert rows(Vw.device_listing(types, state)) == [
        ("D", "AVAILABLE", "D-AGENT", "NOT DEPLOYED", "NOT DEPLOYED")]
    assert rows(Vw.agent_listing(types, state)) == [("G", "AVAILABLE", "5000")]
    assert Vw.app_listing(types, state).first()["application_version"] == "UNAVAILABLE"


def test_discovery(spark):
    types = spark.createDataFrame([("R2", "Reg"), ("R1", "Reg"), ("C1", "Coord")], "asset_uuid string, type string")
    avail = spark.createDataFrame([("R1", "AVAILABLE")], "asset_uuid string, availability string")
    wanted = spark.createDataFrame([("Reg",), ("Coord",), ("None",)], "type string")
    assert rows(Vw.discover_by_type(types, avail, wanted).select("type", "asset_uuid", "error")) == [
        ("Coord", "C1", "not_available"), ("None", None, "not_deployed"), ("Reg", "R1", None)]


def test_registration(spark):
    req = spark.createDataFrame(
        [("A", "Device", None, {"inc": "P", "asset": "A"}, "P/A"), ("B", "Device", "s", None, None)],
        "asset_uuid string, asset_type string, docker_service string, uns_levels map<string,string>, uns_id string")
    ev = R.register_events(req)
    assert rows(ev.where("asset_uuid = 'B'").select("id", "value", "type", "tag")) == [
        ("AssetType", "Device", "Platform", "AssetType"), ("DockerService", "s", "Platform", "DockerService"),
        ("references_above", "", "Platform", "AssetsReferences"),
        ("references_below", "", "Platform", "AssetsReferences")]
    assert ev.where("asset_uuid = 'A'").count() == 7
    m = R.register_uns_map(req, F.timestamp_millis(F.lit(1761338400000)))
    record = m.first()
    assert record["key"] == "A" and json.loads(record["value"]) == {
        "ASSET_UUID": "A", "UNS_ID": "P/A", "UNS_LEVELS": {"inc": "P", "asset": "A"},
        "UPDATED_AT": 1761338400000}
    gone = R.deregister_events(req.select("asset_uuid").limit(1))
    assert gone.where("value IS NULL").count() == 4 and gone.count() == 6


def test_replicas(spark):
    apps = spark.createDataFrame([("APP", 1), ("X", 2)], "uuid string, replicas int")
    assert rows(R.replica_uuids(apps).select("replica_uuid")) == [("APP",), ("X-1",), ("X-2",)]
    assets = spark.createDataFrame([("APP",), ("APP-1",), ("APP-x",), ("X-12",), ("APP-1-2",)], "asset_uuid string")
    assert rows(R.match_replicas(assets, apps)) == [("APP", "APP"), ("APP", "APP-1"), ("X", "X-12")]


def test_prometheus_targets(spark):
    df = spark.createDataFrame([("A", "a", 4000, "/m")], "application_uuid string, host string, port int, path string")
    r = Vw.prometheus_targets(df).first()
    assert r["targets"] == ["a:4000"] and r["labels"] == {"__metrics_path__": "/m"}
    assert Vw.prometheus_targets(df.limit(0)).count() == 0
