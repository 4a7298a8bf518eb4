"""Streams over several files and restarts give what the batch gives."""

import operator
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from plantlog.operators import events as E, state as St, uns
from plantlog.operators.sampling import deadband_filter
from plantlog.schema import ASSET_EVENT
from plantlog.streaming import (
    compact_upserts,
    deliver_by_uns,
    for_each_row_batch,
    message_routes,
    push_query,
    read_upserts,
    stream_deadband,
    stream_latest_state,
    stream_table,
    stream_wait_until,
    upsert_sink,
    wait_until,
)
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


@pytest.fixture
def log(spark, tmp_path):
    """A log of 3 files plus one more that arrives later; returns (folder, add_last, all events)."""
    rnd = random.Random(9)
    data = []
    for o in range(400):
        a = "A0" if rnd.random() < .4 else f"A{rnd.randrange(6)}"
        i, v, t = rnd.choice([
            ("temp", str(round(rnd.random() * 40, 1)), "Samples"), ("temp", None, "Samples"),
            ("AssetType", rnd.choice(["Device", "delete"]), "Platform"),
            ("avail", rnd.choice(["AVAILABLE", "UNAVAILABLE", "delete", None]), "Events"),
            ("DockerService", f"svc{o}", "Platform")])
        data.append((a, i, v, "T", t, {"timestamp": f"t{o}"}, 0, o, T0 + timedelta(seconds=o)))
    folder = str(tmp_path / "log")

    def write(lo, hi):
        spark.createDataFrame(data[lo:hi], ASSET_EVENT).coalesce(1).write.mode("append").parquet(folder)

    for lo in (0, 100, 200):
        write(lo, lo + 100)
    return folder, lambda: write(300, 400), spark.createDataFrame(data, ASSET_EVENT)


def stream(spark, folder):
    return spark.readStream.schema(ASSET_EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def test_state_tables_equal_batch_across_a_restart(spark, log, tmp_path):
    folder, add_last, batch = log
    jobs = {
        "state": (lambda df: St.latest_state(E.enrich(df)), ["key"], St.latest_state(E.enrich(batch))),
        "type": (lambda df: St.last_change(E.type_changes(df), "type"), ["asset_uuid"], St.assets_type(batch)),
        "avail": (lambda df: St.last_change(E.availability_changes(df), "availability"), ["asset_uuid"],
                  St.assets_avail(batch)),
        "service": (lambda df: St.last_change(E.service_changes(df), "docker_service"), ["asset_uuid"],
                    St.docker_services(batch))}
    for name, (plan, keys, _) in jobs.items():
        stream_table(plan(stream(spark, folder)), str(tmp_path / name), str(tmp_path / f"{name}-c")).awaitTermination()
    add_last()
    for name, (plan, keys, want) in jobs.items():
        out = str(tmp_path / name)
        stream_table(plan(stream(spark, folder)), out, str(tmp_path / f"{name}-c")).awaitTermination()
        got = read_upserts(spark, out, keys)
        if name != "state":
            got = got.dropna()
        assert rows(got.select(*want.columns)) == rows(want), name
    assert spark.read.parquet(str(tmp_path / "state")).select("batch_id").distinct().count() == 4
    again = compact_upserts(spark, str(tmp_path / "state"), ["key"], str(tmp_path / "compacted"))
    want = jobs["state"][2]
    assert rows(again.select(*want.columns)) == rows(want)


def test_replay_gives_the_same_state(spark, log, tmp_path):
    folder, add_last, batch = log
    add_last()
    for run in ("one", "two"):
        stream_latest_state(stream(spark, folder), str(tmp_path / run), str(tmp_path / f"{run}-c")).awaitTermination()
    a, b = (rows(read_upserts(spark, str(tmp_path / r), ["key"])) for r in ("one", "two"))
    assert a == b


def test_names_as_of_arrival(spark, log, tmp_path):
    folder, add_last, batch = log
    add_last()
    m = spark.createDataFrame([("A0", 50, "n1"), ("A0", 150, None), ("A0", 250, "n2"), ("A1", 0, "m")],
                              "asset_uuid string, offset long, uns_id string").withColumn(
        "log_time", F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("offset")))
    out = str(tmp_path / "named")
    deliver_by_uns(stream(spark, folder), lambda: m, out, str(tmp_path / "c")).awaitTermination()
    cols = ["uns_id", "asset_uuid", "offset"]
    assert rows(spark.read.parquet(out).select(cols)) == rows(uns.stream_by_uns(batch, m).select(cols))


def test_failed_delivery_is_repeated_once(spark, log, tmp_path):
    folder, _, _ = log
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "c")
    write, calls = upsert_sink(out), []

    def flaky(batch, batch_id):
        write(batch, batch_id)
        calls.append(batch_id)
        if calls.count(1) == 1 and batch_id == 1:
            raise RuntimeError("down")

    with pytest.raises(StreamingQueryException):
        for_each_row_batch(stream(spark, folder), flaky, ckpt).awaitTermination()
    for_each_row_batch(stream(spark, folder), flaky, ckpt).awaitTermination()
    assert calls == [0, 1, 1, 2]
    assert spark.read.parquet(out).count() == 300


def test_deadband_stream_equals_batch(spark, log, tmp_path):
    folder, add_last, batch = log
    add_last()
    num = F.expr("try_cast(value as double)").alias("value_num")
    cols = ["asset_uuid", "id", "offset", num]
    out = str(tmp_path / "kept")
    push_query(stream_deadband(stream(spark, folder).select(*cols), 5.0), out, str(tmp_path / "c")).awaitTermination()
    want = deadband_filter(batch.select(*cols), 5.0, ["asset_uuid", "id"])
    assert rows(spark.read.parquet(out)) == rows(want)


def test_wait_until_stream(spark, log, tmp_path):
    folder, add_last, batch = log
    add_last()
    out = str(tmp_path / "waits")
    since = batch.agg(F.expr("min(log_time) + INTERVAL 30 SECONDS")).first()[0]
    args = "temp", 38, operator.gt, since, 60
    stream_wait_until(stream(spark, folder), *args, location=out, checkpoint=str(tmp_path / "c")).awaitTermination()
    want = rows(wait_until(batch, *args))
    assert want and rows(read_upserts(spark, out, ["asset_uuid"]).select(*wait_until(batch, *args).columns)) == want


def test_late_partition_still_counts(spark, tmp_path):
    folder, out = str(tmp_path / "log"), str(tmp_path / "waits")
    one = lambda a, v, o, s: (a, "x", v, "T", "Events", None, 0, o, T0 + timedelta(seconds=s))
    spark.createDataFrame([one("A", "go", 1, 500), one("B", "on", 2, -1)], ASSET_EVENT).write.parquet(f"{folder}/a")
    spark.createDataFrame([one("B", "go", 3, 9), one("C", "go", 4, -50), one("B", "go", 5, 400)], ASSET_EVENT
                          ).write.parquet(f"{folder}/b")
    log = spark.readStream.schema(ASSET_EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    stream_wait_until(log, "x", "go", operator.eq, T0, 30, location=out, checkpoint=str(tmp_path / "c")).awaitTermination()
    got = rows(read_upserts(spark, out, ["asset_uuid"]).select("asset_uuid", "matched", "offset"))
    assert got == [("B", True, 3), ("C", True, 4)]


def test_folder_tables_stream_every_row(spark, tmp_path):
    from workload.adapters import Tables
    whole = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    whole.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for place in (str(tmp_path), "/root/testdata/sf0.001"):
        out = str(tmp_path / f"out{len(place)}")
        push_query(Tables(spark, place).stream_events().select("offset"), out, f"{out}-c").awaitTermination()
        assert spark.read.parquet(out).count() == whole.count()


READINGS = [("A", "Execution", "READY", "Events", 0), ("A", "Execution", "ACTIVE", "Events", 10),
            ("B", "Execution", "ACTIVE", "Events", -5), ("C", "Execution", "READY", "Events", -5),
            ("C", "Execution", "ACTIVE", "Events", 31), ("D", "Execution", "ACTIVE", "Events", 3),
            ("E", "Temp", "41.5", "Samples", -1), ("E", "Temp", "42", "Samples", 5)]


def waits(spark, *args, **kw):
    df = spark.createDataFrame([(a, i, v, t, o, T0 + timedelta(seconds=s)) for o, (a, i, v, t, s)
                                in enumerate(READINGS)],
                               "asset_uuid string, id string, value string, type string, offset long, log_time timestamp")
    return rows(wait_until(df, *args, **kw).select("asset_uuid", "matched", "initial", "offset"))


def test_wait_until(spark):
    got = waits(spark, "Execution", "ACTIVE", operator.eq, T0, 30)
    assert got == [("A", True, False, 1), ("B", True, True, 2), ("C", False, False, None)]
    assert waits(spark, "Temp", 42, operator.ge, T0) == [("E", True, False, 7)]
    assert waits(spark, "Temp", 42, operator.gt, T0) == [("E", False, False, None)]
    assert waits(spark, "Temp", 42.0, operator.lt, T0) == [("E", True, True, 6)]


def test_wait_until_needs_a_callable(spark):
    with pytest.raises(TypeError):
        waits(spark, "Temp", 42, 30, T0)


def test_routes(spark):
    df = spark.createDataFrame([("x", "Samples"), ("y", "Platform"), ("m", "Method"), ("z", "Other")],
                               "id string, type string")
    assert rows(message_routes(df, ["x"]).select("id", "route")) == [
        ("m", "contract"), ("x", "Samples"), ("x", "any"), ("x", "attribute"), ("y", "any")]


def test_delivery_retries_replace_their_batch(spark, tmp_path):
    from plantlog.schema import RAW_RECORD
    from plantlog.streaming import deliver_to_clusters
    folder, out = str(tmp_path / "raw"), str(tmp_path / "out")
    good = [(f"A{i}", f'{{"ID":"x","VALUE":{i}}}', 0, i, T0, 0) for i in range(20)]
    bad = [("A1", "{cut", 0, 20, T0, 0), (None, '{"ID":"x"}', 0, 21, T0, 0), ("A1", '{"VALUE":1}', 0, 22, T0, 0)]
    spark.createDataFrame(good + bad, RAW_RECORD).write.parquet(folder)
    for attempt in ("c1", "c2"):  # a second checkpoint delivers batch 0 once more
        deliver_to_clusters(spark.readStream.schema(RAW_RECORD).parquet(folder), ["C1", "C2"], out,
                            str(tmp_path / attempt)).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 23 and {r[0] for r in got.select("cluster").distinct().collect()} <= {"C1", "C2", "dead_letters"}
    assert rows(got.where("cluster = 'dead_letters'").select("offset", "error")) == [
        (20, "bad_json"), (21, "missing_key"), (22, "missing_id")]
    assert got.where("error IS NULL AND payload NOT LIKE '%asset_forwarder_timestamp%'").count() == 0


def test_wait_results_end_with_their_deadline(spark):
    """Equal to the batch answer, over restarts; a silent signal ends too, and no state is left."""
    from datetime import datetime, timedelta
    import operator
    from plantlog import work_dir
    from plantlog.streaming import push_query, stream_wait_result, wait_until

    since = datetime(2024, 1, 1)
    schema = "asset_uuid string, id string, value string, type string, offset long, log_time timestamp"
    at = lambda s: since + timedelta(seconds=s)
    parts = [[("a", "door", "open", "Events", 1, at(-50)), ("b", "door", "shut", "Events", 2, at(-40)), ("c", "door", "shut", "Events", 3, at(-30))],
             [("b", "door", "open", "Events", 4, at(10)), ("c", "lamp", "open", "Events", 5, at(20)), ("d", "door", "open", "Events", 6, at(25))],
             [("a", "lamp", "on", "Events", 7, at(5000)), ("c", "door", "open", "Events", 8, at(5001))],
             [("a", "lamp", "on", "Events", 9, at(9000))]]
    log, out, ckpt = (work_dir(spark, n) for n in ("waits-log", "waits-out", "waits-ckpt"))
    query = None
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(log)
        query = push_query(stream_wait_result(spark.readStream.schema(schema).parquet(log), "door", "open", operator.eq, since, 60),
                           out, ckpt)
        query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("asset_uuid", "matched", "initial", "offset").collect())
    every = spark.createDataFrame(sum(parts, []), schema)
    want = wait_until(every, "door", "open", operator.eq, since, 60).select("asset_uuid", "matched", "initial", "offset").collect()
    assert got == sorted(tuple(r) for r in want) == [("a", True, True, 1), ("b", True, False, 4), ("c", False, False, None)]
    last = [p for p in query.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]
    assert last["numRowsTotal"] == 0


def test_streaming_deadband_with_settings_per_signal(spark):
    from plantlog import work_dir
    from plantlog.streaming import push_query, stream_deadband
    rows = [("a", "x", k, float(k % 7), 3.0) for k in range(40)] + [("a", "y", k, float(k % 2), None) for k in range(10)] + [
        ("a", "x", 50, float("nan"), 3.0), ("b", "x", 60, float("inf"), 1.0)]
    schema = "asset_uuid string, id string, offset long, value_num double, band double"
    log, out = work_dir(spark, "band-log"), work_dir(spark, "band-out")
    spark.createDataFrame(rows, schema).write.parquet(log)
    push_query(stream_deadband(spark.readStream.schema(schema).parquet(log), "band"), out, work_dir(
        spark, "band-ckpt")).awaitTermination()
    got = spark.read.parquet(out).collect()
    kept, last = [], None
    for k in range(40):
        if last is None or abs(k % 7 - last) >= 3:
            kept.append(k)
            last = k % 7
    assert sorted(r.offset for r in got if r.id == "x") == kept and sum(r.id == "y" for r in got) == 10


def test_deadband_of_many_signals_over_restarts(spark):
    """Equal to the batch rule; 12,000 signals lie in a bounded number of state entries."""
    from plantlog import work_dir
    from plantlog.streaming.groups import GROUPS, PAGES
    log, out, ckpt = (work_dir(spark, n) for n in ("many-log", "many-out", "many-ckpt"))
    every = spark.range(48_000).selectExpr("IF(id % 12000 = 7, NULL, concat('a', id % 6000)) asset_uuid", "IF(id % 12000 < 6000, 'x', 'y') id",
                                           "id offset", "CAST((id * 7919) % 23 AS DOUBLE) value_num")
    schema = "asset_uuid string, id string, offset long, value_num double"
    for half in ("offset < 24000", "offset >= 24000"):
        every.where(half).write.mode("append").parquet(log)
        query = push_query(stream_deadband(spark.readStream.schema(schema).parquet(log), 5.0), out, ckpt)
        query.awaitTermination()
    got = spark.read.parquet(out)
    want = deadband_filter(every, 5.0, ["asset_uuid", "id"])
    assert rows(got.where("asset_uuid IS NOT NULL")) == rows(want)
    assert got.where("asset_uuid IS NULL").count() > 0
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= GROUPS * PAGES
