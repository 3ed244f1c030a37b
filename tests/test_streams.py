"""Streams over several micro-batches against the batch operators."""

import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wattloom.operators import incidents
from wattloom.streaming import jobs

START = dt.datetime(2024, 1, 1)
FLAGGED = "id long, building_id string, meter_id string, timestamp timestamp_ntz, actual_kwh double, anomaly_score double, severity string"
STORED = "id string, building_id string, meter_id string, timestamp timestamp_ntz, opened_at timestamp_ntz, actual_reading double, anomaly_score double, severity string, status string"
READING = "id long, building_id string, zone_id string, timestamp timestamp_ntz, meter_reading_kwh double, outdoor_temperature_c double, relative_humidity_pct double, interval_seconds double"


def arrive(spark, folder, batches, schema):
    """Writes one file per batch, in order of arrival."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def stream(spark, folder, schema):
    df = jobs.read_files(spark, folder, schema, files_per_trigger=1)
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def test_cooldown_over_batches_equals_batch(spark, tmp_path):
    rng, rows, at = random.Random(4), [], START
    for i in range(300):
        at += dt.timedelta(seconds=rng.choice([60, 300, 600, 700, 5000]))
        rows.append((i, "b", f"m{i % 3}", at, float(rng.randrange(100)), 0.5, "MEDIUM"))
    folder = arrive(spark, tmp_path / "in", [rows[:100], rows[100:180], rows[180:]], FLAGGED)
    rows += [(1000, "b", None, at, 3.0, 0.5, "MEDIUM"), (1001, "b", None, at, 3.0, 0.5, "MEDIUM")]
    old = [("OLD-0", "b", "m0", START - dt.timedelta(minutes=5), START - dt.timedelta(hours=1), 20.0, 0.7, "MEDIUM", "OPEN"), ("OLD-1", "b", "m1", START, START, 1e9, 0.7, "MEDIUM", "OPEN")]
    stored = spark.createDataFrame(old, STORED)
    folder = arrive(spark, tmp_path / "in", [rows[:100], rows[100:180], rows[180:]], FLAGGED)
    versions = jobs.run_available(jobs.stream_cooldown(stream(spark, folder, FLAGGED), stored), str(tmp_path / "out"), str(tmp_path / "ck"))
    last = versions.groupBy("id").agg(F.max_by(F.struct("timestamp", "opened_at", "actual_reading", "anomaly_score", "updates"), "updates").alias("l")).select("id", "l.*")
    plain = lambda t: t.replace(tzinfo=None)
    got = sorted((r.id, plain(r.timestamp), plain(r.opened_at), r.actual_reading, r.anomaly_score, r.updates) for r in last.collect())
    batch = incidents.incident_cooldown(spark.createDataFrame(rows, FLAGGED), stored).collect()
    assert got == sorted((r.id, r.timestamp, r.opened_at, r.actual_reading, r.anomaly_score, r.updates) for r in batch)
    assert {"ANOM-LIVE-1000", "ANOM-LIVE-1001"} <= {r[0] for r in got}


def test_surge_puts_late_readings_in_their_place(spark, tmp_path):
    schema = "id long, building_id string, timestamp timestamp_ntz, meter_reading_kwh double, forest_label int, anomaly_score double"
    rng = random.Random(7)
    rows = [(i, f"b{i % 2}", START + dt.timedelta(minutes=10 * i), float(rng.randrange(1, 100)), -1 if i % 19 == 0 else 1, -0.1) for i in range(300)]
    late = sorted(rows, key=lambda r: r[0] + rng.choice([0, 0, 3]))  # up to half an hour behind
    end = [(1000 + k, b, START + dt.timedelta(days=30), 1.0, 1, -0.1) for k, b in enumerate(("b0", "b1"))]
    folder = arrive(spark, tmp_path / "in", [late[:80], late[80:81], late[81:200], late[200:], end], schema)
    out = jobs.run_available(jobs.stream_surge(stream(spark, folder, schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    want = incidents.surge_detector(spark.createDataFrame(rows, schema))
    pick = lambda df: sorted((r.id, r.severity, r.actual_reading) for r in df.collect())
    assert pick(out) == pick(want) and len(pick(out)) > 20


def test_ingest_looks_only_into_the_days_of_a_batch(spark, tmp_path):
    batches = [[reading(1, 0), reading(2, 3000)], [reading(3, 0), reading(4, 3001), reading(5, 3001)], [reading(6, 3001), reading(7, 9000), reading(8, 1, -5.0)]]
    folder = arrive(spark, tmp_path / "in", batches, READING)
    accepted, rejected = str(tmp_path / "accepted"), str(tmp_path / "rejected")
    stored = spark.createDataFrame([reading(9, 9000)], READING)
    jobs.stream_ingest_sink(stream(spark, folder, READING), *places(spark), stored, accepted, rejected, str(tmp_path / "ck"))
    rows = {(r.id, str(r.day), r.batch) for r in spark.read.parquet(accepted).collect()}
    assert rows == {(1, "2024-01-01", 0), (2, "2024-01-03", 0), (4, "2024-01-03", 1)}
    assert {r.id for r in spark.read.parquet(rejected).collect()} == {8}


def test_surge_history_crosses_batches(spark, tmp_path):
    schema = "id long, building_id string, timestamp timestamp_ntz, meter_reading_kwh double, forest_label int, anomaly_score double"
    rng = random.Random(6)
    rows = [(i, f"b{i % 2}", START + dt.timedelta(minutes=i), float(rng.randrange(1, 100)), -1 if i % 19 == 0 else 1, -0.1) for i in range(200)]
    folder = arrive(spark, tmp_path / "in", [rows[:30], rows[30:50], rows[50:]], schema)
    out = jobs.run_available(jobs.stream_surge(stream(spark, folder, schema), delay="0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
    want = incidents.surge_detector(spark.createDataFrame(rows, schema))
    pick = lambda df: sorted((r.id, r.severity, r.actual_reading) for r in df.collect() if r.id < 199)
    assert pick(out) == pick(want) and len(pick(out)) > 20


def reading(i, minutes, kwh=1.0, building="b", zone="z"):
    return (i, building, zone, START + dt.timedelta(minutes=minutes), kwh, None, 50.0, 600.0)


def places(spark):
    buildings = spark.createDataFrame([("b",)], "building_id string")
    zones = spark.createDataFrame([("b", "z")], "building_id string, zone_id string")
    meters = spark.createDataFrame([("b", "z", "m")], "building_id string, zone_id string, meter_id string")
    return buildings, zones, meters


def test_ingest_drops_repeats_rejects_and_late_rows(spark, tmp_path):
    batches = [
        [reading(1, 0), reading(2, 0), reading(3, 300)],
        [reading(4, 300), reading(5, 310, -1.0), reading(6, 311, building="x")],
        [reading(7, 10), reading(8, 320)],
    ]
    folder = arrive(spark, tmp_path / "in", batches, READING)
    out = jobs.run_available(jobs.stream_ingest(stream(spark, folder, READING), *places(spark)), str(tmp_path / "out"), str(tmp_path / "ck"))
    kept = {r.id for r in out.collect()}
    assert len(kept & {1, 2}) == 1 and kept - {1, 2} == {3, 8}


def test_hours_come_out_once_complete(spark, tmp_path):
    batches = [[reading(1, 5, 2.0), reading(2, 50, 3.0), reading(3, 70, 4.0)], [reading(4, 40, 1.0), reading(5, 200, 9.0)], [reading(6, 400, 1.0)]]
    folder = arrive(spark, tmp_path / "in", batches, READING)
    out = jobs.run_available(jobs.stream_hourly(stream(spark, folder, READING)), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert {r.timestamp.hour: r.meter_reading_kwh for r in out.collect()} == {0: 6.0, 1: 4.0, 3: 9.0}


def test_latest_ignores_older_readings(spark, tmp_path):
    folder = arrive(spark, tmp_path / "in", [[reading(1, 10, 5.0)], [reading(2, 5, 7.0)], [reading(3, 20, 8.0)]], READING)
    path = str(tmp_path / "out")
    jobs.run_batches(jobs.stream_latest_zone(stream(spark, folder, READING)), jobs.append_batch(path), str(tmp_path / "ck"), "update")
    rows = jobs.newest_versions(spark.read.parquet(path)).collect()
    assert [(r.zone_id, r.meter_reading_kwh) for r in rows] == [("z", 8.0)]


def test_large_batches_are_only_stored(spark, tmp_path):
    folder = arrive(spark, tmp_path / "in", [[reading(i, i) for i in range(30)], [reading(100, 100), reading(101, 101, building="c")]], READING)
    stored, pushed = str(tmp_path / "stored"), str(tmp_path / "pushed")
    jobs.stream_filter_sink(stream(spark, folder, READING), "b", stored, pushed, str(tmp_path / "ck"))
    assert spark.read.parquet(stored).count() == 32
    assert [r.id for r in spark.read.parquet(pushed).collect()] == [100]


def test_waiting_readings_are_kept_as_bytes():
    class State:
        exists, hasTimedOut, watermark = False, False, 0  # noqa: N815

        def getCurrentWatermarkMs(self):  # noqa: N802
            return self.watermark

        def update(self, row):
            self.get, self.exists = row, True

        def setTimeoutTimestamp(self, at):  # noqa: N802
            self.at = at

    def part(ids):
        ts = pd.to_datetime(np.array(ids) * 60, unit="s")
        return pd.DataFrame({"timestamp": ts, "id": ids, "meter_reading_kwh": np.array(ids) * 1.0, "forest_label": 1, "anomaly_score": 0.0})

    state = State()
    ids = list(range(40))
    assert list(jobs._with_lag(("b",), iter([part(ids[20:]), part(ids[:20])]), state)) == []
    assert all(isinstance(x, bytes) for x in state.get) and len(state.get[1]) == 8 * 40
    state.watermark, state.hasTimedOut = 35 * 60_000, True
    (found,) = jobs._with_lag(("b",), iter([]), state)
    assert found["id"].tolist() == list(range(24, 35)) and found["lag_24h"].tolist() == [float(x) for x in range(11)]
    state.watermark, state.hasTimedOut = 100 * 60_000, False
    (found,) = jobs._with_lag(("b",), iter([part([41, 40])]), state)
    assert found["id"].tolist() == list(range(35, 42)) and found["lag_24h"].tolist() == [float(x) for x in range(11, 18)]
