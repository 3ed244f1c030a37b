"""Anomaly rules and incident handling on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions import settings as S
from wattloom.functions.numeric import half_up, trunc_ntz
from wattloom.functions.numeric import sql_round as r
from wattloom.operators import features, forecast, forest, incidents
from wattloom.plans.q_models import Trained, trained
from wattloom.plans.q_sources import advice_sql
from wattloom.plans.registry import query
from wattloom.plans.views import Tables
from wattloom.session import cut_lineage


def hourly_judgement(made: Trained) -> DataFrame:
    """What the forest, fitted on the training hours, says of each building's hours."""
    scored = forest.isolation_forest_score(made.split, made.forest)
    return cut_lineage(
        scored.select(
            "building_id", F.col("timestamp").alias("_hour"), F.col("label").alias("_label"),
            half_up(-F.col("decision"), 6).alias("_surge"), half_up(F.col("anomaly_score"), 4).alias("_score"),
        ),
        "judgement",
    )


def judged(readings: DataFrame, hours: DataFrame) -> DataFrame:
    """Readings, a table or a stream, with the judgement of their hour; hours without features are normal."""
    hour = F.date_trunc("hour", F.col("timestamp").cast("timestamp")).cast("timestamp_ntz")
    joined = readings.withColumn("_hour", hour).join(hours, ["building_id", "_hour"], "left")
    filled = {"forest_label": F.coalesce("_label", F.lit(1)), "anomaly_score": F.coalesce("_surge", F.lit(-0.1)), "forest_score": F.coalesce("_score", F.lit(0.0))}
    return joined.withColumns(filled).drop("_hour", "_label", "_surge", "_score")


@query("residual_severity", "SELECT building_id, timestamp, is_anomaly, severity FROM v_scored", ("v_scored",))
def _(t: Tables) -> DataFrame:
    return incidents.residual_severity(t.scored()).select("building_id", "timestamp", "is_anomaly", "severity")


@query("anomaly_events", f"""
SELECT 'ANOM-' || substr(sha256(concat('replay-v1|', building_id, '|', at_text, '|', printf('%.4f', {r("meter_reading_kwh", 4)}), '|', printf('%.4f', {r("predicted_kwh", 4)}))), 1, 40) AS id,
  building_id, at_text AS timestamp, severity, meter_reading_kwh AS actual_kwh, predicted_kwh, {r("greatest(0, meter_reading_kwh - predicted_kwh)", 6)} AS delta_kwh,
  {r("greatest(0, meter_reading_kwh - predicted_kwh) * 3100", 0)} AS estimated_waste_vnd, {r("greatest(0, meter_reading_kwh - predicted_kwh) * 0.125", 2)} AS estimated_waste_usd, 'OPEN' AS status
FROM (SELECT *, strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS at_text FROM v_scored) q WHERE is_anomaly""", ("v_scored",))
def _(t: Tables) -> DataFrame:
    return incidents.anomaly_events(incidents.residual_severity(t.scored())).select(
        "id", "building_id", "timestamp", "severity", "actual_kwh", "predicted_kwh", "delta_kwh",
        "estimated_waste_vnd", "estimated_waste_usd", "status",
    )


SHARE_SQL = "CASE WHEN zone_id IS NULL THEN 1.0 " + " ".join(f"WHEN zone_id = '{z}' THEN {v}" for z, v in S.ZONE_SHARES.items()) + " ELSE 0.10 END"
EXPECTED_SQL = f"""greatest(0.05, CASE WHEN len(usable) >= 3 THEN list_aggregate(usable, 'median') ELSE expected_building * {SHARE_SQL} END)"""


@query("live_scoring", f"""
SELECT id, building_id, zone_id, meter_id, timestamp, severity, {r("greatest(forest_score, CASE WHEN severity = 'CRITICAL' THEN 0.72 ELSE 0.55 END)", 4)} AS anomaly_score,
  {r("kwh", 3)} AS actual_kwh, {r("expected", 3)} AS predicted_kwh, {r("greatest(0, kwh - expected)", 3)} AS delta_kwh, {r("coalesce(outdoor_temperature_c, 26.0)", 1)} AS outdoor_temp_c,
  {r("greatest(0, kwh - expected) * 3100", 0)} AS estimated_waste_vnd, {r("greatest(0, kwh - expected) * 0.125", 2)} AS estimated_waste_usd,
  concat('Live load spike (', printf('%.2f', {r("ratio", 2)}), 'x expected rate) at ', CASE WHEN zone_id IS NULL THEN 'Tổng tòa nhà' ELSE concat('Khu vực ', zone_id) END) AS description
FROM (SELECT *, CASE WHEN ratio >= 2.0 OR (forest_flag AND ratio >= 1.25 AND ratio >= 1.5) THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity
  FROM (SELECT *, kwh / expected AS ratio FROM (SELECT *, {EXPECTED_SQL} AS expected FROM (
    SELECT i.*, v.forest_label = -1 AS forest_flag, v.forest_score, greatest(0.0, i.meter_reading_kwh * (3600.0 / greatest(1.0, interval_seconds))) AS kwh, list_filter(rates, lambda x: x > 0) AS usable,
      CASE WHEN s.model_load IS NOT NULL THEN greatest(10.0, s.model_load) ELSE coalesce(p.profile_kwh, 200.0) END AS expected_building
    FROM v_rate i JOIN v_live_item v ON v.id = i.id LEFT JOIN v_model_load s ON s.building_id = i.building_id AND s.timestamp = date_trunc('hour', i.timestamp)
    LEFT JOIN v_profile p ON p.building_id = i.building_id AND p.dayofweek = isodow(i.timestamp) - 1 AND p.hour = hour(i.timestamp)) a) b) c
  WHERE (forest_flag AND ratio >= 1.25) OR ratio >= 1.6) d""", ("v_rate", "v_live_item", "v_model_load", "v_profile"))
def _(t: Tables) -> DataFrame:
    made = trained(t)
    load = forecast.arx_predict(made.split, forecast.arx_fit(made.train)).select(
        "building_id", F.col("timestamp").alias("_hour"), half_up(F.col("prediction"), 4).alias("model_load")
    )
    rates = features.meter_hourly_rates(judged(t("v_meter_reading"), hourly_judgement(made)))
    items = rates.withColumn("_hour", trunc_ntz("hour", F.col("timestamp"))).join(load, ["building_id", "_hour"], "left").withColumns(
        {"hours_known": F.when(F.col("model_load").isNotNull(), F.lit(24)).otherwise(F.lit(0)), "forest_flag": F.col("forest_label") == -1}
    )
    return incidents.live_scoring(items, t.profile()).drop("subsystem", "suggested_action")


@query("live_gate", """
SELECT id, batch, timestamp FROM (SELECT *, count(*) OVER (PARTITION BY batch) AS n FROM (SELECT id, timestamp, building_id || strftime(timestamp, '%H:%M') AS batch FROM v_telemetry) a) b
WHERE n <= 20 AND abs(epoch_us(timestamp) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) <= 900 * 1000000""", ("v_telemetry",))
def _(t: Tables) -> DataFrame:
    batches = t("v_telemetry").select("id", "timestamp", F.concat("building_id", F.date_format("timestamp", "HH:mm")).alias("batch"))
    return incidents.live_gate(batches, "batch", "2024-01-15 12:00:00")


SURGE_SQL = f"""
SELECT id, building_id, timestamp, {r("meter_reading_kwh", 2)} AS actual_reading, {r("anomaly_score", 4)} AS anomaly_score, sev AS severity, {advice_sql("sev", r("meter_reading_kwh", 2))} AS suggested_action, 'OPEN' AS status
FROM (SELECT *, CASE WHEN anomaly_score >= 0 OR ratio >= 3.0 THEN 'HIGH' WHEN anomaly_score >= -0.03 OR ratio >= 1.8 THEN 'MEDIUM' ELSE 'LOW' END AS sev
  FROM (SELECT *, CASE WHEN l > 0 THEN meter_reading_kwh / l ELSE 1.0 END AS ratio FROM (
    SELECT *, lag(meter_reading_kwh, 24) OVER w AS l, row_number() OVER w AS n FROM v_live_item WINDOW w AS (PARTITION BY building_id ORDER BY timestamp, id)) a WHERE n > 24) b
  WHERE forest_label = -1 OR anomaly_score >= 0 OR ratio >= 2.5) c"""


@query("surge_detector", SURGE_SQL, ("v_live_item",))
def _(t: Tables) -> DataFrame:
    return incidents.surge_detector(judged(t("v_meter_reading"), hourly_judgement(trained(t))))


def flagged(t: Tables) -> DataFrame:
    """Readings of 15 kWh and more as flagged events; some belong to no meter."""
    return t("v_meter_reading").filter(F.col("meter_reading_kwh") >= 15).select(
        "id", "building_id", F.when(F.col("id") % 50 != 0, F.col("building_id")).alias("meter_id"), "timestamp",
        F.col("meter_reading_kwh").alias("actual_kwh"), (F.col("id") % 100 / 100.0).alias("anomaly_score"),
        F.when(F.col("meter_reading_kwh") >= 60, "CRITICAL").otherwise("MEDIUM").alias("severity"),
    )


@query("incident_cooldown", f"""
SELECT open_id AS id, building_id, meter_id, timestamp, opened_at, actual_reading, anomaly_score, severity, updates FROM (
  SELECT open_id, building_id, meter_id, ts AS timestamp, opened_at, kwh AS actual_reading, score AS anomaly_score, severity, updates,
    row_number() OVER (PARTITION BY meter_id, open_id ORDER BY n DESC) AS last FROM v_cooldown) q WHERE last = 1 AND (open_id LIKE 'ANOM-LIVE-%' OR updates > 0)
UNION ALL SELECT 'ANOM-LIVE-' || CAST(id AS STRING), building_id, meter_id, timestamp, timestamp, actual_kwh, anomaly_score, severity, 0 FROM v_flagged WHERE meter_id IS NULL""", ("v_cooldown",))
def _(t: Tables) -> DataFrame:
    return incidents.incident_cooldown(flagged(t), t("v_open_incident"))


@query("status_transition", """
SELECT request_id, id, CASE WHEN bad THEN 'invalid_status' WHEN missing THEN 'not_found' WHEN seen <> prev OR turn > 1 THEN 'conflict' ELSE 'updated' END AS outcome,
  CASE WHEN missing THEN NULL ELSE prev END AS previous_status, CASE WHEN missing THEN NULL WHEN bad OR seen <> prev OR turn > 1 THEN prev ELSE status END AS current_status,
  CAST(CASE WHEN missing THEN NULL WHEN bad OR seen <> prev OR turn > 1 THEN 0 ELSE 1 END AS BIGINT) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY id, bad ORDER BY request_id) AS turn FROM (
  SELECT seq * 2 + c AS request_id, CASE WHEN seq % 13 = 0 THEN 'ANOM-none' || CAST(seq AS STRING) ELSE id END AS id, coalesce(status, 'OPEN') AS prev, seq % 13 = 0 AS missing,
    CASE WHEN (seq + c) % 9 = 0 THEN 'DONE' ELSE 'RESOLVED' END AS status, (seq + c) % 9 = 0 AS bad, CASE WHEN seq % 4 = 0 THEN 'IGNORED' ELSE coalesce(status, 'OPEN') END AS seen
  FROM v_incident, (SELECT unnest([0, 1]) AS c) k) a) b""", ("v_incident",))
def _(t: Tables) -> DataFrame:
    stored = t("v_incident")
    seq = F.col("seq")
    known = F.coalesce("status", F.lit("OPEN"))
    requests = stored.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (seq * 2 + F.col("c")).alias("request_id"),
        F.when(seq % 13 == 0, F.concat(F.lit("ANOM-none"), seq.cast("string"))).otherwise(F.col("id")).alias("id"),
        F.when(seq % 4 == 0, F.lit("IGNORED")).otherwise(known).alias("seen_status"), F.lit(0).alias("seen_history"),
        F.when((seq + F.col("c")) % 9 == 0, "DONE").otherwise("RESOLVED").alias("status"), F.lit("checked").alias("note"),
    )
    current = stored.withColumn("status_history", F.from_json(F.lit("[]"), incidents.HISTORY_TYPE))
    moved = incidents.status_transition(requests, current, "2024-01-31T00:00:00Z")
    return moved.withColumn("history", F.when(F.col("status_history").isNotNull(), F.size("status_history"))).drop("status_history")


@query("persist_events", """
SELECT id, building_id, timestamp, actual_reading, status FROM v_incident WHERE seq % 3 = 0
UNION ALL SELECT id, building_id, timestamp, actual_reading + 1, 'OPEN' FROM v_incident WHERE seq % 3 <> 0""", ("v_incident",))
def _(t: Tables) -> DataFrame:
    keep = ["id", "building_id", "timestamp", "actual_reading", "status"]
    stored = t("v_incident").filter(F.col("seq") % 3 == 0).select(*keep)
    fresh = t("v_incident").withColumn("c", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "id", "building_id", "timestamp", (F.col("actual_reading") + F.col("c")).alias("actual_reading"), F.lit("OPEN").alias("status"),
        (F.col("seq") * 2 + F.col("c")).alias("arrival"),
    )
    return incidents.persist_events(stored, fresh, "arrival")


@query("incident_union", """
SELECT id, building_id, timestamp, status FROM v_incident WHERE seq % 3 = 0
UNION ALL SELECT id, building_id, timestamp, 'OPEN' FROM v_incident WHERE seq % 3 <> 0""", ("v_incident",))
def _(t: Tables) -> DataFrame:
    keep = ["id", "building_id", "timestamp", "status"]
    stored = t("v_incident").filter(F.col("seq") % 3 == 0).select(*keep)
    current = t("v_incident").select(*keep, F.col("seq").alias("arrival"))
    return incidents.incident_union(current, stored, "arrival")


@query("incident_view", """
SELECT id, building_id, timestamp, CAST(NULL AS STRING) AS subsystem, CAST(json_extract_string(snapshot, '$.predicted_kwh') AS DOUBLE) AS predicted_kwh, CAST(json_extract_string(snapshot, '$.delta_kwh') AS DOUBLE) AS delta_kwh,
  CAST(NULL AS DOUBLE) AS outdoor_temp_c, CAST(json_extract_string(snapshot, '$.estimated_waste_vnd') AS DOUBLE) AS estimated_waste_vnd, CAST(NULL AS DOUBLE) AS estimated_waste_usd, CAST(NULL AS STRING) AS description,
  CASE WHEN snapshot IS NOT NULL THEN seq % 100 / CAST(100 AS DOUBLE) END AS anomaly_score, CASE WHEN snapshot IS NOT NULL THEN 'check ' || CAST(seq % 3 AS STRING) END AS suggested_action,
  CAST(CASE WHEN seq % 4 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_history, CASE WHEN seq % 4 = 0 THEN 'RESOLVED' END AS last_status,
  upper(substr(severity, 1, 1)) || lower(substr(severity, 2)) AS severity, actual_reading AS actual_kwh, status FROM v_incident""", ("v_incident",))
def _(t: Tables) -> DataFrame:
    score = ", \"anomaly_score\": ' || CAST(seq % 100 / CAST(100 AS DOUBLE) AS STRING) || ', \"suggested_action\": \"check ' || CAST(seq % 3 AS STRING) || '\"}"
    stored = t("v_incident").withColumn("snapshot", F.expr(f"substr(snapshot, 1, length(snapshot) - 1) || '{score}'"))
    stored = stored.withColumn("status_history", F.when(F.col("seq") % 4 == 0, F.array(F.lit("OPEN"), F.lit("RESOLVED"))))
    history = F.col("status_history")
    return incidents.incident_view(stored).withColumns({"n_history": F.size(history), "last_status": F.try_element_at(history, F.lit(-1))}).drop("status_history")


@query("detector_quality", f"""
SELECT {r("tp / greatest(tp + fp, 1)", 4)} AS precision, {r("tp / greatest(tp + fn, 1)", 4)} AS recall, {r("2 * tp / greatest(2 * tp + fp + fn, 1)", 4)} AS f1,
  {r("fp / greatest(fp + tn, 1)", 4)} AS false_positive_rate, tp + fn AS positive_count, tp + fn + fp + tn AS total_count
FROM (SELECT count(*) FILTER (WHERE is_injected_anomaly = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE is_injected_anomaly = 0 AND predicted = 1) AS fp,
        count(*) FILTER (WHERE is_injected_anomaly = 1 AND predicted = 0) AS fn, count(*) FILTER (WHERE is_injected_anomaly = 0 AND predicted = 0) AS tn FROM v_labelled) q""", ("v_labelled",))
def _(t: Tables) -> DataFrame:
    labelled = t("v_labelled").select(
        (F.col("is_injected_anomaly") == 1).alias("is_injected_anomaly"), (F.col("predicted") == 1).alias("is_anomaly")
    )
    return incidents.detector_quality(labelled)


INDEXED = "SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY building_id) AS n FROM v_clean"


@query("inject_labelled_anomalies", f"""
SELECT 'night_overrun' AS scenario, building_id, timestamp, CASE WHEN i >= s AND i < s + 8 THEN 750.0 ELSE meter_reading END AS meter_reading, i >= s AND i < s + 8 AS is_injected_anomaly
FROM (SELECT *, min(CASE WHEN i >= 24 AND i < n - 10 AND isodow(timestamp) = 1 AND hour(timestamp) = 22 THEN i END) OVER (PARTITION BY building_id) AS s FROM ({INDEXED}) a) b
UNION ALL SELECT 'peak_spike', building_id, timestamp, CASE WHEN i - s IN (10, 11, 18, 19) THEN 2850.0 ELSE meter_reading END, i - s IN (10, 11, 18, 19)
FROM (SELECT *, min(CASE WHEN i >= 24 AND i < n - 30 AND isodow(timestamp) = 2 AND hour(timestamp) = 0 THEN i END) OVER (PARTITION BY building_id) AS s FROM ({INDEXED}) a) b""", ("v_clean",))
def _(t: Tables) -> DataFrame:
    parts = [
        incidents.inject_labelled_anomalies(t.clean(), s).select(
            F.lit(s).alias("scenario"), "building_id", "timestamp", "meter_reading", "is_injected_anomaly"
        )
        for s in ("night_overrun", "peak_spike")
    ]
    return parts[0].unionByName(parts[1])
