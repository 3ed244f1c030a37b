"""Features, splits, windows and histories on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions import settings as S
from wattloom.functions import text_rules
from wattloom.functions.numeric import half_up
from wattloom.functions.numeric import sql_round as r
from wattloom.operators import features, relations, rows
from wattloom.plans.registry import query
from wattloom.plans.views import LAST_HOUR, Tables

CUT = "2024-01-20 00:00:00"


@query("lag_features", "SELECT building_id, timestamp, meter_reading, air_temperature, lag_1h, lag_24h FROM v_features", ("v_features",))
def _(t: Tables) -> DataFrame:
    return features.lag_features(t.clean())


@query("lag_by_timestamp", """
SELECT a.building_id, a.timestamp, a.meter_reading, coalesce(b.meter_reading, a.p1) AS lag_1h, coalesce(c.meter_reading, a.p24) AS lag_24h
FROM (SELECT *, lag(meter_reading, 1) OVER w AS p1, lag(meter_reading, 24) OVER w AS p24 FROM v_hourly WHERE meter_reading IS NOT NULL WINDOW w AS (PARTITION BY building_id ORDER BY timestamp)) a
LEFT JOIN v_hourly b ON b.building_id = a.building_id AND b.timestamp = a.timestamp - INTERVAL 1 HOUR
LEFT JOIN v_hourly c ON c.building_id = a.building_id AND c.timestamp = a.timestamp - INTERVAL 24 HOUR""", ("v_hourly",))
def _(t: Tables) -> DataFrame:
    known = t.hourly().filter(F.col("meter_reading").isNotNull()).select("building_id", "timestamp", "meter_reading")
    return features.lag_by_timestamp(known)


@query("context_lags", f"""
SELECT 'context' AS mode, building_id, timestamp, meter_reading, lag_1h, lag_24h FROM v_features WHERE timestamp >= TIMESTAMP '{CUT}'
UNION ALL SELECT 'drop', building_id, timestamp, meter_reading, lag_1h, lag_24h FROM (
  SELECT *, lag(meter_reading, 1) OVER w AS lag_1h, lag(meter_reading, 24) OVER w AS lag_24h FROM v_clean WHERE timestamp >= TIMESTAMP '{CUT}' WINDOW w AS (PARTITION BY building_id ORDER BY timestamp)) d WHERE lag_24h IS NOT NULL
UNION ALL SELECT 'backfill', building_id, timestamp, meter_reading,
  first_value(lag_1h IGNORE NULLS) OVER f, first_value(lag_24h IGNORE NULLS) OVER f FROM (
  SELECT *, lag(meter_reading, 1) OVER w AS lag_1h, lag(meter_reading, 24) OVER w AS lag_24h FROM v_clean WHERE timestamp >= TIMESTAMP '{CUT}' WINDOW w AS (PARTITION BY building_id ORDER BY timestamp)) b
  WINDOW f AS (PARTITION BY building_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", ("v_features", "v_clean"))
def _(t: Tables) -> DataFrame:
    clean = t.clean()
    cut = F.lit(CUT).cast("timestamp_ntz")
    target, context = clean.filter(F.col("timestamp") >= cut), clean.filter(F.col("timestamp") < cut)
    parts = [
        features.context_lags(target, context if mode == "context" else None, mode).select(
            F.lit(mode).alias("mode"), "building_id", "timestamp", "meter_reading", "lag_1h", "lag_24h"
        )
        for mode in ("context", "drop", "backfill")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("chronological_split", "SELECT building_id, timestamp, position, part FROM v_split", ("v_split",))
def _(t: Tables) -> DataFrame:
    return t.split().select("building_id", "timestamp", "position", "part")


@query("expanding_folds", """
SELECT building_id, fold, role, count(*) AS rows, min(timestamp) AS first_hour, max(timestamp) AS last_hour FROM (
  SELECT f.fold, q.*, CASE WHEN rn < f.fold * (n // 4) THEN 'train' WHEN f.fold = 3 OR rn < (f.fold + 1) * (n // 4) THEN 'validate' END AS role
  FROM (SELECT building_id, timestamp, row_number() OVER (PARTITION BY building_id ORDER BY timestamp) - 1 AS rn, count(*) OVER (PARTITION BY building_id) AS n FROM v_split WHERE part = 'train') q,
       (SELECT unnest([CAST(1 AS BIGINT), 2, 3]) AS fold) f) z WHERE role IS NOT NULL GROUP BY 1, 2, 3""", ("v_split",))
def _(t: Tables) -> DataFrame:
    train = t.split().filter(F.col("part") == "train").select("building_id", "timestamp")
    return features.expanding_folds(train, 3).groupBy("building_id", "fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_hour"), F.max("timestamp").alias("last_hour")
    )


@query("sequence_windows", f"""
SELECT building_id, timestamp, {r("first_in", 2)} AS first_input, {r("t_now", 2)} AS last_temperature, {r("s_out", 2)} AS target_sum, CAST(168 AS BIGINT) AS n_inputs, CAST(24 AS BIGINT) AS n_targets FROM (
  SELECT building_id, timestamp, air_temperature AS t_now, lag(meter_reading, 167) OVER w AS first_in, lead(meter_reading, 24) OVER w AS last_out,
    sum(meter_reading) OVER (PARTITION BY building_id ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS s_out
  FROM v_clean WINDOW w AS (PARTITION BY building_id ORDER BY timestamp)) q WHERE first_in IS NOT NULL AND last_out IS NOT NULL""", ("v_clean",))
def _(t: Tables) -> DataFrame:
    windows = features.sequence_windows(t.clean(), ["meter_reading", "air_temperature"], "meter_reading")
    total = F.aggregate("targets", F.lit(0.0), lambda a, x: a + x)
    return windows.select(
        "building_id", "timestamp",
        half_up(F.element_at(F.element_at("inputs", 1), 1), 2).alias("first_input"),
        half_up(F.element_at(F.element_at("inputs", -1), 2), 2).alias("last_temperature"),
        half_up(total, 2).alias("target_sum"), F.size("inputs").alias("n_inputs"), F.size("targets").alias("n_targets"),
    )


@query("scale_features", f"""
SELECT s.building_id, s.timestamp, {r("(meter_reading - m) / sd", 4)} AS meter_reading_scaled, {r("(air_temperature - mt) / sdt", 4)} AS air_temperature_scaled
FROM v_split s JOIN (SELECT building_id, avg(meter_reading) AS m, stddev_pop(meter_reading) AS sd, avg(air_temperature) AS mt, stddev_pop(air_temperature) AS sdt FROM v_split WHERE part = 'train' GROUP BY 1) f
  ON f.building_id = s.building_id""", ("v_split",))
def _(t: Tables) -> DataFrame:
    scaled = features.scale_features(t.split(), ["meter_reading", "air_temperature"])
    return scaled.select(
        "building_id", "timestamp", half_up(F.col("meter_reading_scaled"), 4).alias("meter_reading_scaled"),
        half_up(F.col("air_temperature_scaled"), 4).alias("air_temperature_scaled"),
    )


@query("serving_window", """
SELECT building_id, timestamp + (TIMESTAMP '2024-06-05 14:00:00' - end_ts) AS timestamp, meter_reading_kwh FROM (
  SELECT *, max(CASE WHEN i = e THEN timestamp END) OVER (PARTITION BY building_id) AS end_ts FROM (
    SELECT *, coalesce(max(CASE WHEN hit AND i >= 719 THEN i END) OVER (PARTITION BY building_id), max(CASE WHEN hit THEN i END) OVER (PARTITION BY building_id)) AS e FROM (
      SELECT building_id, timestamp, meter_reading_kwh, row_number() OVER (PARTITION BY building_id ORDER BY timestamp) - 1 AS i,
        isodow(timestamp) = 3 AND hour(timestamp) = 14 AS hit FROM v_scored) a) b) c WHERE i BETWEEN e - 719 AND e""", ("v_scored",))
def _(t: Tables) -> DataFrame:
    window = features.serving_window(t.scored(), "2024-06-05 14:20:00")
    return window.select("building_id", "timestamp", "meter_reading_kwh")


@query("latest_per_zone", """
SELECT z.building_id, z.zone_id, r.timestamp, r.meter_reading_kwh, r.outdoor_temperature_c, r.relative_humidity_pct FROM v_zone z
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY building_id, zone_id ORDER BY timestamp DESC, id DESC) AS n FROM v_telemetry) r
  ON r.building_id = z.building_id AND r.zone_id = z.zone_id AND r.n = 1""", ("v_zone", "v_telemetry"))
def _(t: Tables) -> DataFrame:
    return features.latest_per_zone(t("v_zone"), t("v_telemetry"))


@query("building_history", """
SELECT 'total' AS part, building_id, timestamp, meter_reading_kwh FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY timestamp DESC, id DESC) AS n FROM v_telemetry WHERE zone_id IS NULL) a WHERE n <= 168
UNION ALL SELECT 'view', building_id, timestamp, meter_reading_kwh FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY timestamp DESC, id DESC) AS n FROM v_telemetry WHERE zone_id = 'z_view') b WHERE n <= 100""", ("v_telemetry",))
def _(t: Tables) -> DataFrame:
    readings = t("v_telemetry")
    keep = ["building_id", "timestamp", "meter_reading_kwh"]
    total = features.building_history(readings).select(F.lit("total").alias("part"), *keep)
    view = features.building_history(readings, 100, "z_view").select(F.lit("view").alias("part"), *keep)
    return total.unionByName(view)


@query("recent_scope_series", f"""
SELECT building_id, timestamp, {r("sum(meter_reading_kwh)", 4)} AS meter_reading_kwh FROM (
  SELECT *, dense_rank() OVER (PARTITION BY building_id ORDER BY timestamp DESC) AS d FROM (SELECT building_id, date_trunc('minute', timestamp) AS timestamp, meter_reading_kwh FROM v_telemetry) m) q
WHERE d <= 168 GROUP BY 1, 2""", ("v_telemetry",))
def _(t: Tables) -> DataFrame:
    minute = F.date_trunc("minute", "timestamp").cast("timestamp_ntz")
    series = features.recent_scope_series(t("v_telemetry").withColumn("timestamp", minute))
    return relations.round_columns(series, 4, "meter_reading_kwh")


@query("meter_hourly_rates", f"""
SELECT id, meter_id, timestamp, {r("CASE WHEN id % 9 = 0 THEN 900.0 ELSE interval_seconds END", 3)} AS interval_seconds, CAST(len(rates) AS BIGINT) AS n_rates, {r("list_sum(rates)", 3)} AS rate_sum, {r("rates[1]", 3)} AS newest_rate FROM v_rate""", ("v_rate",))
def _(t: Tables) -> DataFrame:
    rates = F.col("recent_meter_hourly_kwhs")
    # some meters tell their interval themselves
    readings = t("v_meter_reading").withColumn("interval_seconds", F.when(F.col("id") % 9 == 0, F.lit(900.0)))
    return features.meter_hourly_rates(readings).select(
        "id", "meter_id", "timestamp", half_up(F.col("interval_seconds"), 3).alias("interval_seconds"),
        F.size(rates).alias("n_rates"),
        half_up(F.when(F.size(rates) > 0, F.aggregate(rates, F.lit(0.0), lambda a, x: a + x)), 3).alias("rate_sum"),
        half_up(F.get(rates, F.lit(0)), 3).alias("newest_rate"),
    )


# some turns ask on in the ways the rule knows, others only seem to
ASKED = """CASE turn % 4 WHEN 0 THEN 'Giải thích thêm về ' || message WHEN 1 THEN 'Vì sao thế ' || substr(message, 1, 5) WHEN 2 THEN message || ' sao' ELSE message END"""


def any_of(needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains(m, '{n}')" for n in needles) + ")"


@query("conversation_tail", f"""
SELECT session_id, turn, role, role = 'user' AND follow AS is_follow_up, CASE WHEN role = 'user' AND follow THEN before END AS context FROM (
  SELECT *, lag(lower(message)) OVER (PARTITION BY session_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS n,
    {any_of(S.FOLLOW_UP_PHRASES)} OR {any_of(S.FOLLOW_UP_WORDS)} AND len(regexp_extract_all(m, '[^\\s]+')) <= 6 AS follow
  FROM (SELECT *, lower(message) AS m FROM (SELECT session_id, turn, role, {ASKED} AS message FROM v_turn) asked) low) q WHERE n <= 10""", ("v_turn",))
def _(t: Tables) -> DataFrame:
    turns = t("v_turn").withColumn("message", F.expr(ASKED))
    return relations.conversation_tail(turns, text_rules.is_follow_up(F.col("message"))).drop("message")


@query("run_history", """
SELECT run_id, run_at, row_number() OVER (ORDER BY run_at DESC NULLS LAST, run_id) AS position FROM (
  SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 THEN NULL ELSE o_orderdate END AS run_at FROM orders) q""")
def _(t: Tables) -> DataFrame:
    text = (
        F.when(F.col("o_orderkey") % 17 == 0, F.lit("yesterday"))
        .when(F.col("o_orderkey") % 19 == 0, F.lit(None).cast("string"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    runs = t.base("orders").select(F.col("o_orderkey").alias("run_id"), text.alias("timestamp"))
    ordered = features.run_history(runs)
    # the place in the list, so that the order itself is compared
    return rows.global_position(
        ordered.select("run_id", "run_at"), [F.col("run_at").desc_nulls_last(), F.col("run_id")], "runs"
    )


@query("temperature_proxy", f"""
SELECT building_id, timestamp + INTERVAL 24 HOUR AS timestamp, air_temperature FROM v_clean WHERE timestamp > {LAST_HOUR} - INTERVAL 24 HOUR""", ("v_clean", "v_span"))
def _(t: Tables) -> DataFrame:
    return features.temperature_proxy(t.clean()).drop("step")


@query("forecast_features", f"""
SELECT building_id, step, timestamp, hour(timestamp) AS hour, {r("air_temperature", 2)} AS air_temperature, {r("lag_24h", 2)} AS lag_24h, {r("CASE WHEN step = 1 THEN last_kwh ELSE prev END", 2)} AS lag_1h FROM (
  SELECT building_id, timestamp + INTERVAL 24 HOUR AS timestamp, air_temperature, meter_reading AS lag_24h, lag(meter_reading) OVER w AS prev, row_number() OVER w AS step,
    last_value(meter_reading) OVER (PARTITION BY building_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_kwh
  FROM v_clean WHERE timestamp > {LAST_HOUR} - INTERVAL 24 HOUR WINDOW w AS (PARTITION BY building_id ORDER BY timestamp)) q""", ("v_clean", "v_span"))
def _(t: Tables) -> DataFrame:
    from wattloom.operators.forecast import forecast_features

    return forecast_features(t.clean()).select("building_id", "step", "timestamp", "hour", "air_temperature", "lag_24h", "lag_1h")


@query("observed_plus_forecast", """
SELECT building_id, timestamp, meter_reading_kwh, is_anomaly, predicted_kwh, CAST(NULL AS DOUBLE) AS band_low, CAST(NULL AS DOUBLE) AS band_high FROM (
  SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY timestamp DESC) AS n FROM v_scored) o WHERE n <= 72
UNION ALL SELECT building_id, timestamp, NULL, false, predicted_kwh, lower_bound_95, CASE WHEN lower_bound_95 IS NULL THEN NULL ELSE upper_bound_95 END FROM (
  SELECT building_id, timestamp, predicted_kwh, CASE WHEN hour(timestamp) = 5 THEN NULL ELSE lower_bound_95 END AS lower_bound_95, upper_bound_95 FROM v_forecast) f""", ("v_scored", "v_forecast"))
def _(t: Tables) -> DataFrame:
    forecast = t.forecast().withColumn("lower_bound_95", F.when(F.hour("timestamp") != 5, F.col("lower_bound_95")))
    both = relations.observed_plus_forecast(t.scored(), forecast)
    band = F.col("confidence_interval_95")
    return both.select(
        "building_id", "timestamp", "meter_reading_kwh", "is_anomaly", "predicted_kwh",
        band[0].alias("band_low"), band[1].alias("band_high"),
    )


@query("recent_events", """
SELECT id, building_id, timestamp, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY arrival DESC, id DESC) AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY arrival DESC, id DESC) AS n FROM (SELECT *, seq * 7919 % 100003 AS arrival FROM v_incident) late) a WHERE n <= 1000 AND severity = 'CRITICAL') b WHERE m <= 50""", ("v_incident",))
def _(t: Tables) -> DataFrame:
    # many arrive long after their time
    events = t("v_incident").withColumn("arrival", F.col("seq") * 7919 % 100003)
    return relations.recent_events(events, "building_id", 50, "critical").select("id", "building_id", "timestamp", "severity")
