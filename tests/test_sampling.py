import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from plantlog.operators import sampling
from tests.conftest import rows


def brute(values, band):
    kept, last = [], None
    for i, v in enumerate(values):
        if last is None or abs(v - last) >= band:
            kept.append(i)
            last = v
    return kept


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-300, 300), min_size=1, max_size=60), st.integers(1, 120), st.integers(1, 20))
def test_chunk_summaries_give_the_sequential_result(raw, band, size):
    """Summarise and fold the chunks, then walk each from its entry value: same as one long walk."""
    values, band = np.array(raw) / 7.0, band / 7.0
    last, kept = float("nan"), []
    for start in range(0, len(values), size):
        chunk = values[start:start + size]
        kept += [start + i for i in sampling._walk(chunk, band, last)]
        up, down = sampling._summary(chunk, band)
        last = sampling._outgoing(last, np.asarray(up), np.asarray(down), band)
    assert kept == brute(values.tolist(), band)


@pytest.mark.parametrize("chunk_rows", [150, 200_000])
def test_deadband_with_a_hot_signal(spark, chunk_rows):
    rng = np.random.default_rng(1)
    n = 4000
    k = np.where(rng.random(n) < .4, 0, rng.integers(1, 30, n))
    v = np.round(np.where(k == 0, np.cumsum(rng.normal(0, 1, n)), np.arange(n) * 0.3), 2)
    pdf = pd.DataFrame({"k": k.astype(str), "offset": np.arange(n), "value_num": v})
    df = spark.createDataFrame(pdf).repartition(5)
    got = sampling.deadband_filter(df, 5.0, ["k"], chunk_rows=chunk_rows)
    want = sorted(int(g["offset"].iloc[i]) for _, g in pdf.groupby("k")
                  for i in brute(g["value_num"].tolist(), 5.0))
    assert sorted(r[0] for r in got.select("offset").collect()) == want


@pytest.mark.parametrize("chunk_rows", [40, 200_000])
def test_deadband_without_nan_and_infinite_values(spark, chunk_rows):
    rng = np.random.default_rng(2)
    v = np.round(np.cumsum(rng.normal(0, 1, 600)), 2)
    v[rng.integers(0, 600, 60)], v[rng.integers(0, 600, 20)] = np.nan, np.inf
    pdf = pd.DataFrame({"k": "a", "offset": np.arange(600), "value_num": v})
    got = sampling.deadband_filter(spark.createDataFrame(pdf).repartition(3), 3.0, ["k"], chunk_rows=chunk_rows)
    good = pdf[np.isfinite(pdf["value_num"])]
    want = [int(good["offset"].iloc[i]) for i in brute(good["value_num"].tolist(), 3.0)]
    assert sorted(r[0] for r in got.select("offset").collect()) == want


def test_no_deadband_keeps_everything(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, None)], "k string, offset long, value_num double")
    assert sampling.deadband_filter(df, 0, ["k"]).count() == 2


def test_sample_interval(spark):
    df = spark.createDataFrame([("a", 1, "2024-01-01 00:00:01"), ("a", 2, "2024-01-01 00:00:09"),
                                ("a", 3, "2024-01-01 00:00:10")], "k string, offset long, t string")
    df = df.withColumn("log_time", df.t.cast("timestamp"))
    assert rows(sampling.sample_interval(df, 10, ["k"]).select("offset")) == [(2,), (3,)]
    assert sampling.sample_interval(df, 0, ["k"]).count() == 3


def test_each_signal_has_its_own_settings(spark):
    rng = np.random.default_rng(3)
    data = [(k, i, float(round(v, 2)), b) for k, b in (("a", 1.0), ("b", 5.0), ("c", None), ("d", 0.0))
            for i, v in enumerate(np.cumsum(rng.normal(0, 1, 200)))]
    df = spark.createDataFrame(data, "k string, offset long, value_num double, band double").repartition(3)
    want = []
    for k, b in (("a", 1.0), ("b", 5.0), ("c", None), ("d", 0.0)):
        own = [r for r in data if r[0] == k]
        keep = brute([r[2] for r in own], b) if b else range(len(own))
        want += [own[i] for i in keep]
    for chunk_rows in (50, 200_000):
        assert rows(sampling.deadband_filter(df, "band", ["k"], chunk_rows=chunk_rows)) == sorted(want, key=repr)

    from pyspark.sql import functions as F
    timed = df.withColumn("log_time", F.timestamp_seconds("offset")).withColumn(
        "every", F.expr("map('a', 10, 'b', 60, 'd', 0)[k]"))
    got = rows(sampling.sample_interval(timed, F.col("every"), ["k"]).groupBy("k").count())
    assert got == [("a", 20), ("b", 4), ("c", 200), ("d", 200)]
