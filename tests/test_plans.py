"""The physical plans stay the intended ones."""

import pytest

import __spark_entry__ as entry
from plantlog import work_dir
from plantlog.operators import events as E, routing, state as St, uns
from plantlog.operators.views import point_lookup
from workload.adapters import CLUSTERS, Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


@pytest.mark.parametrize("name", ["latest_state", "stream_by_uns", "state_by_uns", "route_assets",
                                  "routing_balance", "asset_listing", "device_listing", "queue_time_p95",
                                  "reference_neighbors", "deadband_filter", "bind_command_args",
                                  "match_replicas", "resolve_uns_id", "uns_rollup"])
def test_no_pairwise_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_state_aggregates_before_its_only_shuffle(t):
    text = plan(St.latest_state(E.enrich(t.events)))
    assert text.count("Exchange") == 1
    assert text.index("Exchange") < text.index("partial_max_by")


def test_routing_does_not_shuffle_messages(t):
    text = plan(routing.route(t.events, CLUSTERS))
    head = text[:text.index("BroadcastExchange")]
    assert "hashpartitioning" not in head and "BroadcastHashJoin" in head


def test_small_name_map_leaves_events_in_place(t):
    text = plan(uns.stream_by_uns(t.events, t.map_changelog, strategy="broadcast"))
    assert "BroadcastHashJoin" in text and "Inner" in text  # the NOT NULL filter removed the outer join
    assert text.count("FileScan parquet") == text.count("ReadSchema")


def test_column_pruning_reaches_the_scan(t):
    text = plan(St.assets_avail(t.control))
    scan = text[text.index("ReadSchema"):]
    assert "o_totalprice" not in scan and "o_orderdate" not in scan


def test_filters_reach_the_scan(t, spark, tmp_path):
    St.write_state(St.latest_state(E.enrich(t.events)), str(tmp_path / "state"))
    lookup = plan(point_lookup(spark.read.parquet(str(tmp_path / "state")), "ASSET-8|error"))
    assert "EqualTo(key,ASSET-8|error)" in lookup and "Exchange" not in lookup
    text = plan(t.table("orders").where("o_orderstatus = 'F'").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text


def test_written_intermediates_go_to_the_shared_folder(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared and work_dir(spark, "x").startswith(f"{shared}/x-")


def test_filters_on_asset_and_signal_reach_the_scan(spark, tmp_path):
    from plantlog.operators import events as E, state as St
    from workload.adapters import Tables
    log = Tables(spark, "/root/testdata/sf0.001").events
    log.write.parquet(str(tmp_path / "log"))
    stored = spark.read.schema(log.schema).parquet(str(tmp_path / "log"))
    for fold in (St.latest_state, St.latest_by_timestamp):
        state = fold(E.enrich(stored)).where("asset_uuid = 'ASSET-1' AND id = 'view'")
        plan = state._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(asset_uuid,ASSET-1)" in plan and "EqualTo(id,view)" in plan


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    import pytest
    from plantlog.session import work_dir

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(ValueError):
        work_dir(Session, "x")
    for master in ("local", "local[8]", "local[*]"):
        Session.sparkContext.master = master
        assert work_dir(Session, "x")
