"""Continuous tables: removals, renames and restarts against the batch result."""

import random

import pytest
from pyspark.sql import functions as F

from plantlog import work_dir
from plantlog.operators import state as St, uns
from plantlog.streaming import stream_latest_state
from plantlog.streaming import tables as T
from tests.conftest import rows


def log(spark, name):
    return work_dir(spark, name), work_dir(spark, f"{name}-ckpt")


def append(df, folder, files=2):
    df.repartition(files).write.mode("append").parquet(folder)


MAP = "asset_uuid string, uns_id string, area string, offset long"


def test_changelog_table_after_deletion_reinsert_and_restart(spark):
    source, _ = log(spark, "map")
    out, ckpt = log(spark, "map-table")
    parts = [
        [("a", "n/a", "x", 1), ("b", "n/b", None, 2), ("c", "n/c", "z", 3), ("d", None, None, 4)],
        [("a", None, None, 10), ("b", "n/b2", "y", 11), ("e", "n/e", "x", 12), ("e", None, None, 13), (None, "q", "q", 14)],
        [("a", "n/a3", "w", 20), ("c", "old", "old", 0), ("e", "n/e9", None, 21), ("b", None, None, 22)]]
    all_ = []
    for part in parts:
        all_ += part
        append(spark.createDataFrame(part, MAP), source)
        stream = spark.readStream.schema(MAP).parquet(source)
        T.stream_changelog_table(T.changes(stream, "asset_uuid", ["uns_id", "area"]), out, ckpt).awaitTermination()
        changelog = spark.createDataFrame(all_, MAP).select(F.col("asset_uuid").alias("k"), F.when(
            F.coalesce("uns_id", "area").isNotNull(), F.struct("uns_id", "area")).alias("v"), "offset")
        got = T.read_table(spark, out, "uns_id string, area string", "k")
        assert rows(got) == rows(St.changelog_snapshot(changelog))
    sent = spark.read.parquet(out)
    # A removal is a row of its own, a change below the position already seen is none.
    assert {(r.key, r.position) for r in sent.where("op = 'delete'").collect()} == {("a", 10), ("b", 22)}
    assert sent.where("payload LIKE '%old%'").count() == 0


def test_a_hot_key_is_folded_before_the_shuffle(spark):
    source, _ = log(spark, "hot")
    append(spark.range(20_000).selectExpr("'k' asset_uuid", "CAST(id AS STRING) uns_id", "'' area", "id offset"), source, 4)
    seen = []
    folded = T.last_per_task(T.changes(spark.readStream.schema(MAP).parquet(source), "asset_uuid", ["uns_id"]))
    folded.writeStream.foreachBatch(lambda df, _: seen.append(df.count())).option(
        "checkpointLocation", work_dir(spark, "hot-ckpt")).trigger(availableNow=True).start().awaitTermination()
    assert sum(seen) <= 8


EVENTS = ("asset_uuid string, id string, value string, tag string, type string, attributes map<string,string>, "
          "partition int, offset long, log_time timestamp")


def readings(r, n, start):
    return [(f"A{r.randrange(8)}", r.choice(["x", "y", "z"]), str(r.randrange(99)), "t", "Samples", {"timestamp": f"s{k}"}, 0,
             start + k, None) for k in range(n)]


@pytest.mark.parametrize("first", ["readings", "names"])
def test_state_by_uns_and_readings_follow_renames(spark, first):
    r = random.Random(3)
    events, names, state = (log(spark, n)[0] for n in ("ev", "names", "state"))
    (by_uns, ckpt), (per_asset, ckpt2), ckpt1 = log(spark, "by-uns"), log(spark, "per-asset"), work_dir(spark, "state-ckpt")
    all_events, all_names, written = [], [], []
    for step in range(3):
        new_events = readings(r, 40, 1000 * step)
        new_names = [(f"A{k}", None if r.random() < .2 else f"line/{r.randrange(5)}", None, 100 * step + k)
                     for k in range(8) if step == 0 or r.random() < .4]
        all_events += new_events
        all_names += new_names
        append(spark.createDataFrame(new_events, EVENTS), events)
        append(spark.createDataFrame(new_names, MAP), names)
        stream = spark.readStream.schema(EVENTS).parquet(events)
        stream_latest_state(stream, state, ckpt1).awaitTermination()
        updates = T.state_updates(spark, state)
        if first == "names":
            updates = updates.where("true")
        T.stream_state_by_uns(updates, spark.readStream.schema(MAP).parquet(names), by_uns, ckpt).awaitTermination()
        T.stream_readings_by_asset(T.state_updates(spark, state), per_asset, ckpt2).awaitTermination()
        from plantlog.operators.events import enrich
        want_state = St.latest_state(enrich(spark.createDataFrame(all_events, EVENTS)))
        want = uns.state_by_uns(want_state, St.uns_map(spark.createDataFrame(all_names, MAP)))
        columns = ["key", "uns_id", "asset_uuid", "id", "value", "type", "tag", "timestamp"]
        assert rows(T.read_state_by_uns(spark, by_uns).select(columns)) == rows(want.select(columns))
        assert rows(T.read_readings(spark, per_asset)) == rows(St.readings_by_asset(want_state))
        written.append(spark.read.parquet(by_uns).count())
    # Only touched assets are written again.
    assert written[2] - written[1] < 8 * 3 * 2


def state_rows(query):
    return [p for p in query.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]["numRowsTotal"]


def test_keys_of_a_table_share_pages_and_stay_apart(spark):
    """20,000 keys lie in a bounded number of state entries; repeated and stale removals are sent once."""
    from plantlog.streaming.groups import GROUPS, PAGES
    source, _ = log(spark, "many")
    out, ckpt = log(spark, "many-table")
    steps = ["concat('n', id)", "IF(id % 2 = 0, NULL, concat('m', id))", "NULL", "IF(id % 4 = 0, 'back', NULL)"]
    for step, name in enumerate(steps):
        at = f"id + {step if step != 2 else 0} * 100000"  # the third round comes late
        append(spark.range(20_000).selectExpr("concat('k', id) asset_uuid", f"CAST({name} AS STRING) uns_id",
                                              "CAST(NULL AS STRING) area", f"{at} - IF({step} = 2, 1, 0) offset"), source)
        query = T.stream_changelog_table(T.changes(spark.readStream.schema(MAP).parquet(source), "asset_uuid", ["uns_id"]), out, ckpt)
        query.awaitTermination()
    assert state_rows(query) <= GROUPS * PAGES
    sent = {(r.batch_id, r.op): r["count"] for r in spark.read.parquet(out).groupBy("batch_id", "op").count().collect()}
    assert sent == {(0, "upsert"): 20_000, (1, "upsert"): 10_000, (1, "delete"): 10_000, (3, "upsert"): 5_000, (3, "delete"): 10_000}
    got = T.read_table(spark, out, "uns_id string", "k")
    assert got.count() == 5_000 and got.where("uns_id <> 'back' OR CAST(substr(k, 2) AS INT) % 4 <> 0").count() == 0


def test_names_of_many_assets_share_pages(spark):
    from plantlog.streaming.groups import GROUPS, PAGES
    events, names, state = (log(spark, n)[0] for n in ("ev2", "names2", "state2"))
    (out, ckpt), ckpt1 = log(spark, "by-uns2"), work_dir(spark, "state2-ckpt")
    append(spark.createDataFrame([(f"A{k}", "x", str(k), "t", "Samples", {}, 0, k, None) for k in range(50)], EVENTS), events)
    stream_latest_state(spark.readStream.schema(EVENTS).parquet(events), state, ckpt1).awaitTermination()
    for step in range(2):
        append(spark.range(12_000).selectExpr("concat('A', id) asset_uuid", f"concat('line/', {step}, '/', id) uns_id",
                                              "CAST(NULL AS STRING) area", f"id + {step} * 100000 offset"), names)
        query = T.stream_state_by_uns(T.state_updates(spark, state), spark.readStream.schema(MAP).parquet(names), out, ckpt)
        query.awaitTermination()
        assert sorted(r.key for r in T.read_state_by_uns(spark, out).collect()) == sorted(f"line/{step}/{k}|x" for k in range(50))
    assert state_rows(query) <= GROUPS * PAGES


def test_bounded_batches_are_shared_by_consumers(spark):
    """No micro-batch is larger with several consumers, and none of them reads the log in a row."""
    from workload.adapters import Tables
    from workload.q_tables import FILES, RECORDS, consumed
    t = Tables(spark, "/root/testdata/sf0.001")
    records = spark.range(24_500).selectExpr("CAST(NULL AS STRING) key", "'v' value", "CAST(id % 3 AS INT) partition", "id offset",
                                             "CAST(NULL AS TIMESTAMP) timestamp", "0 timestampType").coalesce(1)
    seen = consumed(t, records, 4)
    assert sorted(r.offset for r in seen.collect()) == list(range(24_500))
    batches = seen.groupBy("consumer", "batch_id").count().collect()
    assert max(b["count"] for b in batches) <= FILES * RECORDS and len({b.consumer for b in batches}) == 4
    assert max(b.batch_id for b in batches) + 1 < 24_500 / (FILES * RECORDS)
    assert consumed(t, records.limit(0), 4).count() == 0
