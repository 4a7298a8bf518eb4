import bisect
import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantlog.operators import metrics as M, routing
from tests.conftest import rows


def owner(keys, nodes, replicas):
    spot = {int(hashlib.sha256(f"{n}::{r}".encode()).hexdigest(), 16): n for n in nodes for r in range(replicas)}
    order = sorted(spot)
    out = {}
    for k in keys:
        i = bisect.bisect(order, int(hashlib.sha256(k.encode()).hexdigest(), 16))
        out[k] = spot[order[i % len(order)]]
    return out


@pytest.mark.parametrize("nodes, replicas", [
    (["node1", "node2", "node3"], 10), (["C1", "C2", "C3"], 128), (["only"], 1),
    ([f"n{i}" for i in range(40)], 128)])
def test_ring_equals_bisection(spark, nodes, replicas):
    keys = [f"key-{i}" for i in range(1000)]
    df = spark.createDataFrame([(k,) for k in keys], "asset_uuid string")
    got = dict(rows(routing.route(df, nodes, replicas=replicas)))
    assert got == owner(keys, nodes, replicas)


def test_ring_needs_nodes(spark):
    with pytest.raises(ValueError):
        routing.hash_ring(spark, [])


def test_reassignment_only_to_new_node(spark):
    df = spark.createDataFrame([(f"key-{i}",) for i in range(1000)], "asset_uuid string")
    moved = routing.ring_reassignment(df, ["node1", "node2"], ["node1", "node2", "node3"])
    targets = {r["new_cluster"] for r in moved.collect()}
    assert targets == {"node3"} and 0 < moved.count() < 1000


def test_every_cluster_is_used(spark):
    df = spark.createDataFrame([(f"asset-{i}",) for i in range(500)] + [(None,)], "asset_uuid string")
    b = rows(routing.routing_balance(df, ["C1", "C2", "C3"]))
    assert len(b) == 3 and sum(r[1] for r in b) == 500


T0 = datetime(2024, 1, 1)


def test_rate_handles_restart_and_borders(spark):
    samples = [(0, 10), (30, 16), (61, 20), (90, 3), (200, 5)]
    df = spark.createDataFrame([("f", T0 + timedelta(seconds=s), v) for s, v in samples],
                               "forwarder string, ts timestamp, value long")
    got = [(r["window_start"].minute, round(r["rate"] * 60)) for r in
           M.counter_rate(df, ["forwarder"]).orderBy("window_start").collect()]
    assert got == [(0, 6), (1, 4 + 3), (3, 2)]


def buckets(spark, *pairs):
    return spark.createDataFrame([("f", float(le), float(v)) for le, v in pairs], "f string, le double, rate double")


@pytest.mark.parametrize("pairs, q, want", [
    (((1, 5), (2, 10), (float("inf"), 10)), 0.75, 1.5),
    (((1, 10), (2, 10), (float("inf"), 10)), 0.5, 0.5),
    (((1, 0), (2, 0), (float("inf"), 10)), 0.5, 2.0),
    (((1, 0), (2, 0), (float("inf"), 0)), 0.5, None),
    (((0, 10), (1, 10), (float("inf"), 10)), 0.5, 0.0)])
def test_quantile(spark, pairs, q, want):
    assert M.histogram_quantile(buckets(spark, *pairs), q, ["f"]).first()["quantile"] == want


def test_both_histogram_layouts_agree(spark):
    df = spark.range(400).select(
        F.concat(F.lit("f"), F.col("id") % 2).alias("f"), (F.col("id") % 13 / 10.0).alias("v"),
        F.timestamp_seconds(1704067200 + F.floor(F.col("id") / 40) * 30).alias("ts"))
    bounds = (0.0, 0.3, 0.9)
    tall = M.histogram(df, "v", bounds, ["f", "ts"]).select("f", "le", "ts", "value")
    wide = M.histogram_columns(df, "v", bounds, ["f", "ts"])
    a = rows(M.windowed_quantile(tall, 0.9, ["f"]))
    assert a == rows(M.windowed_quantile_columns(wide, 0.9, ["f"], bounds)) and len(a) == 10


def test_histogram_bounds_are_inclusive(spark):
    df = spark.createDataFrame([("f", 0.1), ("f", 0.2), ("f", 5.0)], "f string, v double")
    h = {r["le"]: r["value"] for r in M.histogram(df, "v", (0.1, 0.5), ["f"]).collect()}
    assert h == {0.1: 1, 0.5: 2, float("inf"): 3}


def test_stage_latencies(spark):
    attrs = {"timestamp": "2024-01-01T00:00:00.000Z", "kafka_timestamp": "2024-01-01T00:00:00.040Z",
             "asset_forwarder_timestamp": "2024-01-01T00:00:00.055Z"}
    df = spark.createDataFrame([("A", "x", 1, attrs), ("A", "x", 2, {"timestamp": "UNAVAILABLE"})],
                               "asset_uuid string, id string, offset long, attributes map<string,string>")
    assert rows(M.stage_latencies(df).select("source_to_log_ms", "log_to_forwarder_ms")) == [(40, 15), (None, None)]


def test_latest_labels(spark):
    df = spark.createDataFrame([("f", T0, "v1"), ("f", T0 + timedelta(1), "v2")], "f string, ts timestamp, version string")
    r = M.latest_labels(df, "f", ["version"], {"role": "forwarder"}).first()
    assert (r["version"], r["role"]) == ("v2", "forwarder")
    assert rows(M.gauge_current(df.withColumn("q", F.lit(3)), "f", "q")) == [("f", 3)]


def test_counters_of_one_pass(spark):
    r = random.Random(4)
    data = [(f"F{r.randrange(2)}", "hot" if r.random() < .4 else r.choice([f"A{r.randrange(9)}", None]), *(
        r.random() < p for p in (.2, .2, .3, .1))) for _ in range(800)]
    df = spark.createDataFrame(data, "forwarder string, asset_uuid string, is_error boolean, is_invalid boolean, "
                                     "is_failed boolean, opens_call boolean").repartition(4)
    per_asset, nodes = M.asset_counters(df), ["C1", "C2", "C3"]
    want = {f: [0] * 4 for f, *_ in data}
    for f, _, error, invalid, _, opens in data:
        want[f] = [a + b for a, b in zip(want[f], (not error, error, not error and invalid, opens))]
    assert rows(M.forwarder_counters(per_asset)) == sorted((f, *v) for f, v in want.items())
    home = owner({a for _, a, *_ in data if a}, nodes, 128)
    sent = {}
    for _, a, error, invalid, failed, _ in data:
        if not error and not invalid:
            n = sent.setdefault(home.get(a), [0, 0])
            n[failed] += 1
    assert rows(M.cluster_counters(per_asset, nodes)) == sorted(((c, *v) for c, v in sent.items()), key=repr)


def test_latency_sketches_against_exact_ranks(spark):
    r = random.Random(5)
    data = [("hot" if r.random() < .8 else f"a{r.randrange(4)}", r.randrange(6), int(r.expovariate(.001)))
            for _ in range(30_000)] + [("none", 0, None), ("hot", 0, None), ("one", 1, 7)]
    df = spark.createDataFrame(data, "asset_uuid string, hour int, ms long").repartition(6)
    hourly = M.latency_sketches(df, "ms", ["asset_uuid", "hour"])
    got = M.sketch_quantiles(M.merge_sketches(hourly, ["asset_uuid"]), {"p50": .5, "p95": .95, "p99": .99}).collect()
    assert len(got) == 7
    for row in got:
        values = [v for a, _, v in data if a == row.asset_uuid and v is not None]
        assert row.n == len(values)
        for name, rank in (("p50", .5), ("p95", .95), ("p99", .99)):
            q = row[name]
            if not values:
                assert q is None
            elif len(values) == 1:
                assert q == 7
            else:
                assert sum(v < q for v in values) / len(values) <= rank + .02
                assert sum(v <= q for v in values) / len(values) >= rank - .02
