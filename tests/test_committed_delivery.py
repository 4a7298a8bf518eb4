"""Delivery with a commit protocol: failures and repeats leave no row twice."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plantlog import work_dir
from plantlog.sources import delivery as D

ROWS = "cluster string, subject string, n long"


def append(spark, folder, lo, hi):
    spark.range(lo, hi).selectExpr("IF(id % 5 = 0, NULL, concat('C/', id % 3)) cluster", "concat('s', id) subject", "id n").write.mode(
        "append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(ROWS).parquet(folder)


def delivered(spark, out, **kwargs):
    return sorted(r.n for r in D.read_delivered(spark, out, "subject string, n long", **kwargs).collect())


def test_growing_log_with_restarts_and_a_failed_batch(spark):
    log, out, ckpt = (work_dir(spark, n) for n in ("dlog", "dout", "dckpt"))
    append(spark, log, 0, 100)
    D.deliver(stream(spark, log), out, ckpt).awaitTermination()
    assert delivered(spark, out) == list(range(100))
    append(spark, log, 100, 200)
    # The task that meets row 150 fails after other tasks have written.
    broken = stream(spark, log).withColumn("subject", F.expr("IF(n = 150, raise_error('lost'), subject)"))
    with pytest.raises(Exception):
        D.deliver(broken, out, ckpt).awaitTermination()
    assert delivered(spark, out) == list(range(100))
    append(spark, log, 200, 230)
    D.deliver(stream(spark, log), out, ckpt).awaitTermination()
    assert delivered(spark, out) == list(range(230))
    assert delivered(spark, out, cluster="C/1") == [n for n in range(230) if n % 5 and n % 3 == 1]
    assert delivered(spark, out, cluster=D.NO_CLUSTER) == [n for n in range(230) if n % 5 == 0]
    counts = D.delivered_counts(spark, out)
    assert counts.agg(F.sum("rows")).first()[0] == 230 and counts.select("batch").distinct().count() == counts.agg(
        F.max("batch") + 1).first()[0]
    named = {r.path for r in D._files(spark, out).collect()}
    D.remove_uncommitted(spark, out, older_than_seconds=-5)
    assert {f"data/{f}" for f in os.listdir(f"{out}/data") if not f.startswith(".")} == named


def test_a_batch_committed_twice_counts_once(spark, tmp_path):
    writer = D.DeliveryWriter(str(tmp_path))
    batch = pa.RecordBatch.from_pydict({"cluster": ["a", "b", None], "subject": ["x", "y", "z"], "n": [1, 2, 3]})
    writer.commit([writer.write(iter([batch])), None], 7)
    again = writer.write(iter([batch, batch]))
    writer.commit([again], 7)
    assert delivered(spark, str(tmp_path)) == [1, 2, 3]
    assert not any((tmp_path / f[0]).exists() for f in again.files)
    lost = writer.write(iter([batch]))
    writer.abort([lost, None], 8)
    assert not any((tmp_path / f[0]).exists() for f in lost.files)
    assert D.remove_uncommitted(spark, str(tmp_path), older_than_seconds=-5) == 0


def test_empty_folder_and_missing_column(spark):
    assert D.read_delivered(spark, _with_manifest(spark), "subject string, n long").count() == 0
    with pytest.raises(Exception, match="cluster"):
        log = work_dir(spark, "nolog")
        append(spark, log, 0, 3)
        D.deliver(stream(spark, log).drop("cluster"), work_dir(spark, "no"), work_dir(spark, "nockpt")).awaitTermination()


def _with_manifest(spark):
    out = work_dir(spark, "none")
    D.DeliveryWriter(out).commit([D.Written()], 0)
    return out


def test_fan_out_job_may_run_again(spark):
    from plantlog.sources import write_by_cluster
    out = work_dir(spark, "fan")
    rows = spark.createDataFrame([("C1", 1), ("C2", 2), (None, 3)], "cluster string, n long")
    for _ in range(2):
        write_by_cluster(rows, out, job="j1")
    write_by_cluster(rows.where("n = 1"), out, job="j2")
    got = sorted((r.cluster, r.n) for r in spark.read.parquet(out).collect())
    assert got == [("C1", 1), ("C1", 1), ("C2", 2), ("dead_letters", 3)]
