"""Streams replayed in other orders than time, against the batch operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galvana.operators import cycles
from galvana.plans import base
from galvana.streaming import summaries


def replay(spark, frames, folder):
    for k, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{folder}/part{k:03d}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part*")


def finished(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return df.sparkSession.table(name)


@pytest.fixture
def samples(spark, sf_dir):
    rows = base.samples(spark, sf_dir).withColumn("cell_id", F.col("cell_id").cast("string")).select("cell_id", "row_id", "time", "current", "voltage")
    return rows.toPandas().sort_values(["time", "row_id"]).reset_index(drop=True)


def test_shuffled_batches_give_the_cycles_of_the_table(spark, samples, tmp_path):
    rng = np.random.default_rng(3)
    hour = 3600.0
    arrival = samples["time"].to_numpy() + rng.random(len(samples)) * 5 * hour  # late by up to five hours
    order = np.argsort(arrival)
    parts = [spark.createDataFrame(samples.iloc[i]) for i in np.array_split(order, 5)]
    end = samples["time"].max()
    clock = [spark.createDataFrame([("clock", -k, float(end + k * 40 * 24 * hour), 0.0, 3.0)], parts[0].schema) for k in (1, 2, 3)]
    stream = replay(spark, parts + clock, tmp_path / "in")
    found = finished(summaries.cycle_summaries(stream, 50.0, "6 hours", idle_s=30 * 24 * hour), tmp_path, "summaries").where("cell_id <> 'clock'")
    got = {(r.cell_id, r.cycle_index): r for r in found.collect()}
    want = {(r.cell_id, r.cycle_index): r for r in cycles.cycle_meta(cycles.with_cycles(spark.createDataFrame(samples)), 50.0).collect()}
    assert got.keys() == want.keys() and len(got) == found.count() and all(r.part == 0 for r in got.values())
    for key, r in got.items():
        for c in ("n_points", "duration_s", "voltage_min", "voltage_max", "voltage_range", "charge_capacity_ah", "discharge_capacity_ah", "c_rate_est"):
            assert abs(r[c] - want[key][c]) <= 1e-6 * max(1, abs(want[key][c])), (key, c)


def test_a_silent_cell_is_closed_and_may_go_on(spark, tmp_path):
    row = lambda c, i, t, a: (c, i, float(t + 100), float(a), 3.0 + i / 100)
    batches = [
        [row("a", 0, 0, 1), row("a", 1, 10, 1), row("b", 0, 5, -1)], [row("b", 1, 5000, -1)], [row("clock", 0, 9000, 0)],
        [row("a", 2, 9100, -1), row("a", 3, 9110, -1), row("a", 4, 9120, 1)], [row("clock", 1, 60000, 0)], [row("clock", 2, 70000, 0)],
    ]
    frames = [spark.createDataFrame(b, "cell_id string, row_id long, time double, current double, voltage double") for b in batches]
    found = finished(summaries.cycle_summaries(replay(spark, frames, tmp_path / "in"), None, "1 second", idle_s=1000.0), tmp_path, "silent")
    got = sorted((r.cell_id, r.cycle_index, r.part, r.n_points) for r in found.where("cell_id <> 'clock'").collect())
    assert got == [("a", 0, 0, 2), ("a", 0, 1, 2), ("a", 1, 0, 1), ("b", 0, 0, 2)]  # b spoke before it was found silent


def test_sessions_of_a_stream_equal_those_of_the_table(spark, samples, tmp_path):
    rng = np.random.default_rng(5)
    order = np.argsort(samples["time"].to_numpy() + rng.random(len(samples)) * 3600)
    parts = [spark.createDataFrame(samples.iloc[i]) for i in np.array_split(order, 4)]
    clock = [spark.createDataFrame([("clock", -k, float(samples["time"].max() + k * 1e7), 1.0, 3.0)], parts[0].schema) for k in (1, 2)]
    stream = replay(spark, parts + clock, tmp_path / "in")
    found = finished(summaries.rest_sessions(stream, 7001.5, lateness="2 hours"), tmp_path, "sessions").where("cell_id <> 'clock'")
    key = lambda r: (r.cell_id, r.sign, r.begin, r.end, r.n_points, r.voltage_min, r.voltage_max, round(r.ampere_seconds, 6))
    assert sorted(map(key, found.collect())) == sorted(map(key, summaries.rest_sessions(spark.createDataFrame(samples), 7001.5).collect()))
