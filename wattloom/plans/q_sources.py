"""Sources, sinks, cleaning and scalar rules on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions import rules
from wattloom.functions import settings as S
from wattloom.functions.numeric import half_up
from wattloom.functions.numeric import sql_round as r
from wattloom.operators import aggregates, cleaning, evaluation, forecast
from wattloom.plans.registry import query
from wattloom.plans.views import Tables, rule_models
from wattloom.session import cut_lineage, scratch
from wattloom.sources import files


@query("scan_meter_metadata", """
SELECT building_id, CAST(site_id AS BIGINT) AS site_id, building_type AS primary_use, total_area_sqm AS sqm, 'UTC' AS timezone
FROM v_building WHERE lower(building_type) = 'office'""", ("v_building",))
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "metadata")
    t("v_building").select(
        "building_id", "site_id", F.col("building_type").alias("primaryspaceusage"),
        F.col("total_area_sqm").alias("sqm"), F.lit("UTC").alias("timezone"),
    ).write.option("header", True).csv(path)
    return files.scan_meter_metadata(t.spark, path)


@query("unpivot_meters", """
SELECT building_id, timestamp, meter_reading FROM v_hourly WHERE building_id <> 'b3'""", ("v_hourly",))
def _(t: Tables) -> DataFrame:
    hourly = t.hourly()
    wide = hourly.groupBy("timestamp").pivot("building_id", ["b0", "b1", "b2", "b3"]).agg(F.first("meter_reading"))
    known = t("v_telemetry").select("building_id").distinct().filter(F.col("building_id") != "b3")
    return files.unpivot_meters(wide, known)


FIRST_WEATHER = """
SELECT site_id, timestamp, air_temperature FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, timestamp ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM v_weather) q WHERE n = 1"""
WEATHER_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("scan_site_weather", f"SELECT CAST(site_id AS BIGINT) AS site_id, timestamp, air_temperature FROM ({FIRST_WEATHER}) w", ("v_weather",))
def _(t: Tables) -> DataFrame:
    return files.scan_site_weather(t("v_weather"), WEATHER_ORDER)


@query("scan_telemetry", "SELECT building_id, timestamp, meter_reading, air_temperature FROM v_clean", ("v_clean",))
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "telemetry")
    t.clean().withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).write.option("header", True).csv(path)
    return files.scan_telemetry(t.spark, path)


@query("standardise_columns", "SELECT building_id, timestamp, meter_reading, air_temperature FROM v_hourly", ("v_hourly",))
def _(t: Tables) -> DataFrame:
    return files.standardise_columns(t.hourly().withColumnsRenamed({"meter_reading": "load_kwh", "air_temperature": "airTemperature"}))


@query("strict_json_rows", """
SELECT event_id, CASE WHEN error IS NULL THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, error
FROM (SELECT event_id, props, CASE WHEN event_id % 10 IN (0, 7) THEN 'invalid_json' WHEN event_id % 10 = 5 THEN 'wrong_type' WHEN event_id % 10 = 3 THEN 'non_finite' END AS error FROM events) a""")
def _(t: Tables) -> DataFrame:
    text = (
        F.when(F.col("event_id") % 10 == 0, F.expr("substring(props, 1, length(props) - 2)"))
        .when(F.col("event_id") % 10 == 5, F.concat(F.lit("["), "props", F.lit("]")))
        .when(F.col("event_id") % 10 == 7, F.concat("props", F.lit(" {}")))
        .when(F.col("event_id") % 10 == 3, F.expr("concat('{\"other\": {\"deep\": [NaN]}, ', substring(props, 2))"))
        .when(F.col("event_id") % 10 == 8, F.expr("concat('{\"said\": \"NaN, -Infinity\", ', substring(props, 2))"))
        .otherwise(F.col("props"))
    )
    raw = t.base("events").select("event_id", text.alias("p"))
    return files.strict_json_rows(raw, "p", "k BIGINT").select("event_id", "k", "error")


def all_predictions(t: Tables) -> DataFrame:
    """Rolling-origin predictions of the rule models and, recursively, of the weights fitted on the training rows."""
    test = t.with_profile().filter(F.col("part") == "test")
    trained = forecast.arx_fit(t.kept_split().filter(F.col("part") == "train"))
    return evaluation.horizon_predictions(test, rule_models()).unionByName(forecast.arx_horizons(test, trained))


def evaluation_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions of three rules and of a trained model, their hour-1 metrics and their errors by horizon."""
    predictions = cut_lineage(all_predictions(t), "predictions")
    results = evaluation.forecast_metrics(predictions.filter(F.col("horizon_h") == 1), "model").drop("rows")
    return predictions, results, evaluation.horizon_scoring(predictions)


def written_artifacts(t: Tables) -> str:
    path = scratch(t.spark, "artifacts")
    files.write_predictions(*evaluation_tables(t), path)
    return path


@query("write_predictions", """
SELECT model, building_id, origin_timestamp, CAST(horizon_h AS BIGINT) AS horizon_h, target_timestamp, actual, prediction FROM v_prediction""", ("v_prediction",))
def _(t: Tables) -> DataFrame:
    return t.spark.read.parquet(f"{written_artifacts(t)}/predictions")


@query("load_forecast_artifacts", """
SELECT p.model, CAST(p.horizon_h AS BIGINT) AS horizon_h, p.n AS predictions, h.mae, h.rmse, s.mape
FROM (SELECT model, horizon_h, count(*) AS n FROM v_prediction GROUP BY 1, 2) p
JOIN v_by_horizon h ON h.model = p.model AND h.horizon_h = p.horizon_h JOIN v_result s ON s.model = p.model""", ("v_by_horizon", "v_result"))
def _(t: Tables) -> DataFrame:
    results, by_horizon, predictions = files.load_forecast_artifacts(t.spark, written_artifacts(t))
    counted = predictions.groupBy("model", "horizon_h").agg(F.count(F.lit(1)).alias("predictions"))
    return counted.join(by_horizon, ["model", "horizon_h"]).join(results.select("model", "mape"), "model")


DAILY = f"""
SELECT building_id, strftime(timestamp, '%Y-%m-%d') AS day, {r("sum(coalesce(meter_reading, 0))", 2)} AS consumption_kwh,
  {r("greatest(max(coalesce(meter_reading, 0)), 0)", 2)} AS peak_demand_kw, count(*) AS readings
FROM v_daily_meter GROUP BY 1, 2"""


@query("export_daily_csv", f"""
SELECT building_id, day AS "Ngày", consumption_kwh AS "Điện năng (kWh)", peak_demand_kw AS "Công suất đỉnh (kW)", readings AS "Số bản ghi" FROM ({DAILY}) d""", ("v_daily_meter",))
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "daily")
    files.export_daily_csv(aggregates.daily_breakdown(t("v_daily_meter")), path)
    day, kwh, peak, n = S.DAILY_HEADER
    return files.read_daily_csv(t.spark, path).select(
        "building_id", day, F.col(kwh).cast("double").alias(kwh), F.col(peak).cast("double").alias(peak), F.col(n).cast("long").alias(n)
    )


# cleaning


@query("completeness_rank", f"""
SELECT building_id, null_count, zero_count, mean, std, row_number() OVER (ORDER BY null_count, zero_count, std DESC NULLS LAST, building_id) AS rank
FROM (SELECT d.building_id, count(*) FILTER (WHERE meter_reading IS NULL) AS null_count, count(*) FILTER (WHERE meter_reading = 0) AS zero_count,
        {r("avg(meter_reading)", 4)} AS mean, {r("stddev_samp(meter_reading)", 4)} AS std
      FROM v_daily_meter d WHERE d.building_id IN (SELECT building_id FROM v_building WHERE building_type = 'Office') GROUP BY 1) s""", ("v_daily_meter", "v_building"))
def _(t: Tables) -> DataFrame:
    offices = t("v_building").filter(F.col("building_type") == "Office")
    return cleaning.completeness_rank(t("v_daily_meter").join(offices, "building_id", "left_semi"))


@query("merge_weather", f"""
SELECT d.building_id, d.timestamp, d.seq, d.meter_reading, CAST(b.site_id AS BIGINT) AS site_id, w.air_temperature
FROM v_daily_meter d LEFT JOIN v_building b ON b.building_id = d.building_id
LEFT JOIN ({FIRST_WEATHER}) w ON w.site_id = b.site_id AND w.timestamp = d.timestamp""", ("v_daily_meter", "v_building", "v_weather"))
def _(t: Tables) -> DataFrame:
    weather = files.scan_site_weather(t("v_weather"), WEATHER_ORDER)
    return cleaning.merge_weather(t("v_daily_meter"), t("v_building"), weather)


@query("null_profile", """
SELECT 'meter_reading' AS "column", (SELECT count(*) FROM v_hourly WHERE meter_reading IS NULL) AS nulls_before, (SELECT count(*) FROM v_clean WHERE meter_reading IS NULL) AS nulls_after
UNION ALL SELECT 'air_temperature', (SELECT count(*) FROM v_hourly WHERE air_temperature IS NULL), (SELECT count(*) FROM v_clean WHERE air_temperature IS NULL)""", ("v_hourly", "v_clean"))
def _(t: Tables) -> DataFrame:
    columns = ["meter_reading", "air_temperature"]
    return cleaning.null_profile(t.hourly(), t.clean(), columns)


@query("interpolate_linear", "SELECT building_id, timestamp, meter_reading, air_temperature FROM v_clean", ("v_clean",))
def _(t: Tables) -> DataFrame:
    return t.clean()


@query("prepare_hourly_live", """
SELECT id, TRY_CAST(CASE WHEN id % 13 = 0 THEN 'soon' ELSE strftime(timestamp, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS timestamp, meter_reading_kwh AS meter_reading,
  coalesce(outdoor_temperature_c, 26.0) AS air_temperature
FROM v_telemetry WHERE id % 11 <> 0 AND id % 13 <> 0""", ("v_telemetry",))
def _(t: Tables) -> DataFrame:
    bad = F.col("id") % 11 == 0
    raw = t("v_telemetry").select(
        "id",
        F.when(F.col("id") % 13 == 0, F.lit("soon")).otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(bad, F.lit("n/a")).otherwise(F.col("meter_reading_kwh").cast("string")).alias("meter_reading_kwh"),
        F.col("outdoor_temperature_c").cast("string").alias("outdoor_temperature_c"),
    )
    return cleaning.prepare_hourly_live(raw)


# scalar rules


@query("calendar_features", f"""
SELECT building_id, timestamp, hour(timestamp) AS hour, isodow(timestamp) - 1 AS dayofweek, CAST(isodow(timestamp) >= 6 AS BIGINT) AS is_weekend,
  {r("sin(2 * pi() * hour(timestamp) / 24)", 6)} AS hour_sin, {r("cos(2 * pi() * hour(timestamp) / 24)", 6)} AS hour_cos FROM v_hourly""", ("v_hourly",))
def _(t: Tables) -> DataFrame:
    from wattloom.operators.features import calendar_features

    out = calendar_features(t.hourly().select("building_id", "timestamp"))
    return out.withColumns({c: half_up(F.col(c), 6) for c in ("hour_sin", "hour_cos")})


@query("zone_comfort_band", """
SELECT id, CASE WHEN outdoor_temperature_c IS NULL THEN 'Chưa có đo' WHEN outdoor_temperature_c < 22 THEN 'Mát lạnh' WHEN outdoor_temperature_c <= 25 THEN 'Tối ưu'
    WHEN outdoor_temperature_c <= 28 THEN 'Hơi ấm' ELSE 'Nhiệt cao' END AS comfort,
  CASE WHEN meter_reading_kwh IS NULL THEN 'Chưa có đo' WHEN meter_reading_kwh < 40 THEN 'Tiết kiệm' WHEN meter_reading_kwh <= 80 THEN 'Trung bình' ELSE 'Lãng phí cao' END AS load
FROM v_meter_reading""", ("v_meter_reading",))
def _(t: Tables) -> DataFrame:
    return t("v_meter_reading").select(
        "id", rules.temperature_band(F.col("outdoor_temperature_c")).alias("comfort"), rules.load_band(F.col("meter_reading_kwh")).alias("load")
    )


RATIO = "CASE WHEN outdoor_temperature_c > 0 THEN meter_reading_kwh / outdoor_temperature_c ELSE 1.0 END"
SEVERITY = f"CASE WHEN anomaly_score >= 0 OR {RATIO} >= 3.0 THEN 'HIGH' WHEN anomaly_score >= -0.03 OR {RATIO} >= 1.8 THEN 'MEDIUM' ELSE 'LOW' END"


def severity_column():
    return rules.severity(F.col("anomaly_score"), F.col("meter_reading_kwh"), F.col("outdoor_temperature_c"))


@query("severity_rule", f"SELECT id, {SEVERITY} AS severity FROM v_scored_item", ("v_scored_item",))
def _(t: Tables) -> DataFrame:
    return t("v_scored_item").select("id", severity_column().alias("severity"))


def advice_sql(level: str, reading: str) -> str:
    shown = f"printf('%.1f', {r(reading, 1)})"
    arms = {name: "concat('" + text.replace("%s", f"', {shown}, '") + "')" for name, text in S.ADVICE.items()}
    return f"CASE {level} WHEN 'HIGH' THEN {arms['HIGH']} WHEN 'MEDIUM' THEN {arms['MEDIUM']} ELSE {arms['LOW']} END"


@query("suggested_action", f"""
SELECT id, {advice_sql('severity', 'meter_reading_kwh')} AS suggested_action FROM (SELECT id, meter_reading_kwh, {SEVERITY} AS severity FROM v_scored_item) q""", ("v_scored_item",))
def _(t: Tables) -> DataFrame:
    return t("v_scored_item").select("id", rules.advice(severity_column(), F.col("meter_reading_kwh")).alias("suggested_action"))


@query("waste_cost", f"""
SELECT id, {r("meter_reading_kwh * 1.5", 1)} AS excess_kwh, {r("meter_reading_kwh * 1.5 * 3100", 0)} AS cost_vnd, {r("meter_reading_kwh * 1.5 * 0.125", 2)} AS cost_usd FROM v_telemetry""", ("v_telemetry",))
def _(t: Tables) -> DataFrame:
    cost = rules.waste(F.col("meter_reading_kwh"), F.lit(1.5))
    return t("v_telemetry").select("id", *[c.alias(n) for n, c in cost.items()])


@query("interval_bounds", f"""
SELECT id, {r("greatest(0.0, least((meter_reading_kwh - 30) * 1.1, meter_reading_kwh * 1.1))", 6)} AS lower_bound_95, {r("greatest((meter_reading_kwh * 2 - 20) * 1.1, meter_reading_kwh * 1.1)", 6)} AS upper_bound_95
FROM v_telemetry""", ("v_telemetry",))
def _(t: Tables) -> DataFrame:
    kwh = F.col("meter_reading_kwh")
    low, high = rules.band(kwh, kwh - 30, kwh * 2 - 20, 1.1)
    return t("v_telemetry").select("id", half_up(low, 6).alias("lower_bound_95"), half_up(high, 6).alias("upper_bound_95"))


@query("interval_rate", f"""
SELECT id, {r("greatest(0.0, meter_reading_kwh * (3600.0 / greatest(1.0, CASE WHEN s IS NULL OR s = 0 THEN 3600.0 ELSE s END)))", 6)} AS hourly_kwh
FROM (SELECT id, meter_reading_kwh, CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id % 900 AS DOUBLE) END AS s FROM v_telemetry) q""", ("v_telemetry",))
def _(t: Tables) -> DataFrame:
    interval = F.when(F.col("id") % 5 != 0, (F.col("id") % 900).cast("double"))
    return t("v_telemetry").select("id", half_up(rules.hourly_rate(F.col("meter_reading_kwh"), interval), 6).alias("hourly_kwh"))


@query("meter_key", "SELECT id, meter_id FROM v_meter_reading", ("v_meter_reading",))
def _(t: Tables) -> DataFrame:
    return t("v_telemetry").select("id", rules.meter_key(F.col("building_id"), F.col("zone_id")).alias("meter_id"))
