"""The streaming jobs, run over all events until nothing is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.numeric import sql_round as r
from wattloom.plans.q_incidents import SURGE_SQL, hourly_judgement, judged
from wattloom.plans.q_models import trained
from wattloom.plans.registry import query
from wattloom.plans.views import Tables, over
from wattloom.session import scratch
from wattloom.streaming import jobs


def live(t: Tables, view: str, folder: str | None = None, per_trigger: int = 64) -> DataFrame:
    """A shared view over the stream of events instead of the table."""
    pattern = "events.parquet" if folder is None else "*.parquet"
    events = jobs.read_files(t.spark, folder or t.folder, jobs.EVENT_SCHEMA, pattern, per_trigger)
    stream = over(t.spark, f"SELECT * FROM {view}", {"events": events}, view)
    return stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in (names or ("timestamp",))})


@query("stream_ingest", """
SELECT id, building_id, zone_id, timestamp, meter_reading_kwh, CASE WHEN building_id = 'b3' THEN 'unknown_building' WHEN zone_id = 'z_view' THEN 'no_meter' ELSE 'accepted' END AS outcome,
  count(*) FILTER (WHERE building_id = 'b3' OR zone_id = 'z_view') OVER (PARTITION BY id) AS copies FROM (
    SELECT * FROM v_meter_reading UNION ALL SELECT * FROM v_meter_reading WHERE building_id = 'b3' OR zone_id = 'z_view') twice
WHERE id % 7 <> 0 OR building_id = 'b3' OR zone_id = 'z_view'""", ("v_meter_reading",))
def _(t: Tables) -> DataFrame:
    readings = t("v_meter_reading")
    places = readings.select("building_id", "zone_id", "meter_id").distinct().filter(F.col("building_id") != "b3")
    meters = places.filter(F.coalesce(F.col("zone_id") != "z_view", F.lit(True)))
    buildings, zones = places.select("building_id").distinct(), places.filter(F.col("zone_id").isNotNull())
    # the early half comes last, and every reading of it a second time later still
    folder, accepted, rejected, state = (scratch(t.spark, n) for n in ("arrivals", "accepted", "rejected", "state"))
    events = t.base("events")
    early = F.col("event_id") % 2 == 0
    for part in (events.filter(~early), events.filter(early), events):
        part.write.mode("append").parquet(folder)
        stream = live(t, "v_meter_reading", folder, 1_000_000).withColumn("interval_seconds", F.lit(600.0))
        jobs.stream_ingest_sink(stream, buildings, zones, meters, ntz(readings.filter(F.col("id") % 7 == 0)), accepted, rejected, state)
    keep = ["id", "building_id", "zone_id", "timestamp", "meter_reading_kwh"]
    good = t.spark.read.parquet(accepted).select(*keep, F.lit("accepted").alias("outcome"), F.lit(0).alias("copies"))
    bad = t.spark.read.parquet(rejected).select(*keep, F.col("reason").alias("outcome"))
    twice = bad.groupBy(*keep, "outcome").agg(F.count("*").alias("copies"))
    twice = twice.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_c")
    return ntz(good.unionByName(twice))


@query("stream_hourly", f"""
SELECT building_id, date_trunc('hour', timestamp) AS timestamp,
  {r("coalesce(sum(meter_reading_kwh) FILTER (WHERE zone_id IS NOT NULL), sum(meter_reading_kwh) FILTER (WHERE zone_id IS NULL), 0)", 4)} AS meter_reading_kwh,
  {r("coalesce(avg(outdoor_temperature_c), 26.0)", 2)} AS outdoor_temperature_c
FROM v_meter_reading GROUP BY 1, 2 HAVING date_trunc('hour', min(timestamp)) + INTERVAL 1 HOUR <= (SELECT max(timestamp) FROM v_meter_reading) - INTERVAL 1 HOUR""", ("v_meter_reading",))
def _(t: Tables) -> DataFrame:
    stream = jobs.stream_hourly(live(t, "v_meter_reading"))
    return ntz(jobs.run_available(stream, scratch(t.spark, "hourly"), scratch(t.spark, "state")))


@query("stream_latest_zone", """
SELECT building_id, zone_id, timestamp, meter_reading_kwh, id FROM (
  SELECT *, row_number() OVER (PARTITION BY building_id, zone_id ORDER BY timestamp DESC, id DESC) AS n FROM v_meter_reading WHERE zone_id IS NOT NULL) q WHERE n = 1""", ("v_meter_reading",))
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "latest")
    jobs.run_batches(jobs.stream_latest_zone(live(t, "v_meter_reading")), jobs.append_batch(path), scratch(t.spark, "state"), "update")
    return ntz(jobs.newest_versions(t.spark.read.parquet(path)))


@query("stream_surge", f"""
SELECT id, building_id, timestamp, actual_reading, anomaly_score, severity FROM ({SURGE_SQL}) s
WHERE epoch_ms(timestamp) < (SELECT max(epoch_ms(timestamp)) FROM v_live_item) - 3600000""", ("v_live_item",))
def _(t: Tables) -> DataFrame:
    # three arrivals; every other reading comes half an hour late, so some come an arrival later than their neighbours
    folder, out, state = (scratch(t.spark, n) for n in ("arrivals", "surge", "state"))
    hours = hourly_judgement(trained(t))
    events = t.base("events")
    comes = F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") % 2 * 1800
    first, last, _ = (F.unix_seconds(F.lit(x).cast("timestamp")) for x in t.span())
    third = F.floor((comes - first) * 3 / (last - first + 1))
    for part in (events.filter(third <= 0), events.filter(third == 1), events.filter(third >= 2)):
        part.write.mode("append").parquet(folder)
        items = judged(live(t, "v_meter_reading", folder, 1_000_000), hours)
        found = jobs.run_available(jobs.stream_surge(items), out, state)
    return ntz(found)


@query("stream_cooldown", """
SELECT open_id AS id, building_id, meter_id, timestamp, opened_at, actual_reading, anomaly_score, severity, updates FROM (
  SELECT open_id, building_id, meter_id, ts AS timestamp, opened_at, kwh AS actual_reading, score AS anomaly_score, severity, updates,
    row_number() OVER (PARTITION BY meter_id, open_id ORDER BY n DESC) AS last FROM v_cooldown) q WHERE last = 1 AND (open_id LIKE 'ANOM-LIVE-%' OR updates > 0)
UNION ALL SELECT 'ANOM-LIVE-' || CAST(id AS STRING), building_id, meter_id, timestamp, timestamp, actual_kwh, anomaly_score, severity, 0 FROM v_flagged WHERE meter_id IS NULL""", ("v_cooldown",))
def _(t: Tables) -> DataFrame:
    stream = live(t, "v_meter_reading").filter(F.col("meter_reading_kwh") >= 15).select(
        "id", "building_id", F.when(F.col("id") % 50 != 0, F.col("building_id")).alias("meter_id"), "timestamp",
        F.col("meter_reading_kwh").alias("actual_kwh"), (F.col("id") % 100 / 100.0).alias("anomaly_score"),
        F.when(F.col("meter_reading_kwh") >= 60, "CRITICAL").otherwise("MEDIUM").alias("severity"),
    )
    made = jobs.stream_cooldown(stream, t("v_open_incident"))
    versions = jobs.run_available(made, scratch(t.spark, "cooldown"), scratch(t.spark, "state"))
    fields = [f for f in jobs.INCIDENT_FIELDS if f != "id"]
    last = versions.groupBy("id").agg(F.max_by(F.struct(*fields), "updates").alias("_l")).select("id", "_l.*")
    return ntz(last, "timestamp", "opened_at")


@query("stream_filter_sink", """
SELECT 'stored' AS sink, id, building_id, timestamp FROM v_meter_reading UNION ALL SELECT 'pushed', id, building_id, timestamp FROM v_meter_reading WHERE building_id = 'b1' AND id < 15""", ("v_meter_reading",))
def _(t: Tables) -> DataFrame:
    # the first fifteen readings are one batch, what comes later another; the stream goes on where it stopped
    folder, stored, pushed, state = (scratch(t.spark, n) for n in ("arrivals", "stored", "pushed", "state"))
    events = t.base("events")
    for part in (events.filter(F.col("event_id") < 15), events.filter(F.col("event_id") >= 15)):
        part.write.mode("append").parquet(folder)
        jobs.stream_filter_sink(live(t, "v_meter_reading", folder, 1_000_000), "b1", stored, pushed, state)
    parts = [
        t.spark.read.parquet(path).select(F.lit(name).alias("sink"), "id", "building_id", "timestamp")
        for name, path in (("stored", stored), ("pushed", pushed))
    ]
    return ntz(parts[0].unionByName(parts[1]))
