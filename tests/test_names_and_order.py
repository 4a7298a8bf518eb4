import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantlog.functions import asof_join, lag_in_order
from plantlog.operators import state as St, uns
from plantlog.operators.uns import ANY, Namespace
from tests.conftest import rows


def remaps(changelog):
    """Remaps with their time in seconds."""
    return rows(uns.remap_changes(changelog).select("uns_id", "asset_uuid", F.unix_seconds("log_time"), "previous_asset"))


LEVELS = {"inc": "Plant", "area": "A1", "workcenter": ["WC1", "WC2"], "station": ["S1", "S2"],
          "asset": ANY, "attribute": ANY}
NS = Namespace(LEVELS, "inc/area/workcenter/station/asset/attribute")


@pytest.mark.parametrize("levels, error, path", [
    ({"workcenter": "WC2", "station": "S1", "asset": "my_asset"}, None, "Plant/A1/WC2/S1/my_asset"),
    ({"workcenter": "WC1", "station": "S1"}, None, "Plant/A1/WC1/S1/device123"),
    ({"inc": "Plant", "area": "A1", "workcenter": "WC1", "other": "x"}, None, "Plant/A1/WC1/device123"),
    ({}, None, "Plant/A1/device123"),
    ({"area": "WRONG", "workcenter": "WC1"}, "constant:area", None),
    ({"station": "S1"}, "gap", None),
    ({"workcenter": "WC1", "station": "S3"}, "enum:station", None)])
def test_attach(spark, levels, error, path):
    df = spark.createDataFrame([("device123", levels)], "asset_uuid string, levels map<string,string>")
    r = uns.attach_uns(df, NS).first()
    assert (r["error"], r["uns_id"]) == (error, path)
    if path:
        assert r["uns_levels"]["inc"] == "Plant" and "attribute" not in r["uns_levels"]
        assert "other" not in r["uns_levels"]


@pytest.mark.parametrize("levels, template", [
    (LEVELS, "asset"), (LEVELS, "inc/asset"), (LEVELS, "inc/nope/attribute"),
    (LEVELS, "asset/inc/attribute")])
def test_bad_templates(levels, template):
    with pytest.raises(ValueError):
        Namespace(levels, template)


def test_other_separator(spark):
    ns = Namespace({"a": ANY, "asset": ANY, "attribute": ANY}, "a.asset.attribute")
    df = spark.createDataFrame([("d", {"a": "x"})], "asset_uuid string, levels map<string,string>")
    assert uns.attach_uns(df, ns).first()["uns_id"] == "x.d"


def test_asof_against_brute_force(spark):
    rnd = random.Random(5)
    versions = sorted({(f"A{rnd.randrange(6)}", rnd.randrange(0, 5000)) for _ in range(150)})
    versions = [(a, o, rnd.choice([None, f"n{o}"])) for a, o in versions]
    facts = [("A0" if rnd.random() < .4 else f"A{rnd.randrange(8)}", o) for o in range(5000)]
    facts += [(None, 6000)]
    v = spark.createDataFrame(versions + [(None, 1, "never")], "a string, o long, u string")
    f = spark.createDataFrame(facts, "a string, o long").repartition(5)

    def at(a, o):
        past = [(p, u) for k, p, u in versions if k == a and p <= o]
        return max(past)[1] if past else None

    want = sorted(((a, o, at(a, o)) for a, o in facts), key=repr)
    for kw in ({"strategy": "broadcast"}, {"strategy": "bucketed", "bucket_width": 300},
               {"strategy": "bucketed"}, {}):
        assert rows(asof_join(f, v, ["a"], "o", ["u"], **kw)) == want, kw


def test_lag_against_brute_force(spark):
    rnd = random.Random(6)
    data = [("HOT" if rnd.random() < .5 else f"k{rnd.randrange(4)}", o, rnd.choice([None, o]))
            for o in rnd.sample(range(10_000), 1500)]
    df = spark.createDataFrame(data, "k string, o long, v long").repartition(5)
    want, last = [], {}
    for k, o, v in sorted(data, key=lambda r: r[1]):
        want.append((k, o, v, last.get(k)))
        last[k] = v
    assert rows(lag_in_order(df, ["k"], ["o"], "v", "p", bucket_width=700)) == sorted(want, key=repr)


def test_asof_and_snapshot_differ(spark):
    ev = spark.createDataFrame([("A", 1), ("A", 5), ("A", 9), ("B", 5)], "asset_uuid string, offset long")
    m = spark.createDataFrame([("A", 2, "n1"), ("A", 6, "n2"), ("A", 9, None), ("B", 7, "b")],
                              "asset_uuid string, offset long, uns_id string")
    ev, m = (df.withColumn("log_time", F.timestamp_seconds("offset")) for df in (ev, m))
    assert rows(uns.stream_by_uns(ev, m).drop("log_time")) == [("A", 5, "n1")]
    current = St.uns_map(m)
    assert rows(current) == [("A", None), ("B", "b")]
    state = spark.createDataFrame([("A|x", "A", "x"), ("B|x", "B", "x")], "key string, asset_uuid string, id string")
    for c in ("value", "type", "tag", "timestamp"):
        state = state.withColumn(c, F.lit("-"))
    assert rows(uns.state_by_uns(state, current).select("key", "asset_uuid_key")) == [("b|x", "B|x")]


def test_resolution_and_remaps(spark):
    m = spark.createDataFrame(
        [("A", 1, "n"), ("B", 2, "n"), ("C", 3, "c"), ("C", 4, None), ("B", 5, "n")],
        "asset_uuid string, offset long, uns_id string").withColumn("log_time", F.timestamp_seconds("offset"))
    asked = spark.createDataFrame([("n",), ("c",)], "uns_id string")
    assert rows(uns.resolve_uns(asked, m)) == [("c", None, 0), ("n", "B", 2)]
    assert remaps(m) == [("n", "B", 2, "A")]
    back = spark.createDataFrame([("B", 5, "N"), ("A", 10, "N"), ("A", 20, "M"), ("B", 30, None), ("C", 40, "N")],
                                 "asset_uuid string, offset long, uns_id string").withColumn(
        "log_time", F.timestamp_seconds("offset"))
    assert remaps(back) == [("N", "A", 10, "B"), ("N", "B", 20, "A"), ("N", "C", 40, "B")]


def test_remaps_against_brute_force(spark):
    rnd = random.Random(8)
    log = [(f"a{rnd.randrange(6)}", o, rnd.choice(["n", "n", "m", None])) for o in rnd.sample(range(999), 200)]
    m = spark.createDataFrame(log, "asset_uuid string, offset long, uns_id string").repartition(4).withColumn(
        "log_time", F.timestamp_seconds("offset"))
    now, owner, want = {}, {}, []
    for a, o, u in sorted(log, key=lambda r: r[1]):
        now[a] = (u, o)
        for name in ("n", "m"):
            held = [(at, x) for x, (v, at) in now.items() if v == name]
            new = max(held)[1] if held else owner.get(name)
            if name in owner and new != owner[name]:
                want.append((name, new, o, owner[name]))
            if new:
                owner[name] = new
    assert remaps(m) == sorted(want, key=repr)


def test_two_logs_meet_by_log_time(spark):
    """The map's offsets restart at 0, an asset has two mappings at one time, and records lack their time."""
    rnd = random.Random(12)
    at = lambda s: None if s is None else datetime(2024, 1, 1) + timedelta(seconds=s)
    log = [(f"a{rnd.randrange(5)}", o, rnd.choice(["n", "m", None]), None if rnd.random() < .05 else o // 2)
           for o in range(120)]
    log.sort(key=lambda r: (r[3] is not None, r[3] or 0))
    log = [(a, o, u, s) for o, (a, _, u, s) in enumerate(log)]
    facts = [(rnd.choice(["a0", f"a{rnd.randrange(6)}"]), 1_000_000 + i, None if rnd.random() < .05 else rnd.randrange(60))
             for i in range(600)]
    m = spark.createDataFrame([(a, o, u, at(s)) for a, o, u, s in log],
                              "asset_uuid string, offset long, uns_id string, log_time timestamp").repartition(3)
    f = spark.createDataFrame([(a, o, at(s)) for a, o, s in facts], "asset_uuid string, offset long, log_time timestamp")
    place = lambda s: -1 if s is None else s

    def named(a, s):
        past = [(place(x), o, u) for k, o, u, x in log if k == a and place(x) <= place(s)]
        return max(past, key=lambda r: r[:2])[2] if past else None

    want = sorted(((a, o, named(a, s)) for a, o, s in facts if named(a, s)), key=repr)
    for kw in ({"strategy": "broadcast"}, {"strategy": "bucketed", "bucket_width": 7_000_000}):
        assert rows(uns.stream_by_uns(f, m, **kw).drop("log_time")) == want, kw


def test_a_later_registration_outlives_a_removal(spark):
    day = [datetime(2024, 1, d) for d in range(1, 6)]
    ev = spark.createDataFrame(
        [(a, "AssetType", v, "Platform", o, day[d]) for a, v, o, d in (
            ("A", "Device", 900, 0), ("B", "Device", 901, 0), ("B", "App", 3_000, 3), ("C", "Device", 5, 2), ("D", "Device", 6, 0))],
        "asset_uuid string, id string, value string, type string, offset long, log_time timestamp")
    m = spark.createDataFrame([("A", "a", 0, day[0]), ("B", "b", 1, day[0]), ("B", "b2", 2, day[3]), ("D", "d", 3, None)],
                              "asset_uuid string, uns_id string, offset long, log_time timestamp")
    gone = spark.createDataFrame([(a, t, day[2]) for a in "ABCE" for t in ("assets_type", "asset_to_uns_map")],
                                 "asset_uuid string, target string, log_time timestamp")
    # C is removed at the very time of its last reading: the removal counts
    assert rows(St.assets_type(ev, removals=gone)) == [("B", "App"), ("D", "Device")]
    assert rows(St.uns_map(m, gone)) == [("A", None), ("B", "b2"), ("C", None), ("D", "d"), ("E", None)]
    named = uns.stream_by_uns(spark.createDataFrame([("A", 1, day[1]), ("A", 2, day[4]), ("B", 3, day[2]), ("B", 4, day[4])],
                              "asset_uuid string, offset long, log_time timestamp"),
                              St.with_removals(m, gone, "asset_to_uns_map"))
    assert rows(named.select("offset", "uns_id")) == [(1, "a"), (4, "b2")]


def test_duplicate_uuids(spark):
    df = spark.createDataFrame([("u", "a"), ("u", "c"), ("u", "b"), ("v", "c")], "uuid string, name string")
    assert rows(uns.duplicate_uuids(df)) == [("u", 3, ["a", "b", "c"])]
