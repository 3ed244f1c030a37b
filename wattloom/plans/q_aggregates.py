"""Aggregations on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions import settings as S
from wattloom.functions.numeric import sql_round as r
from wattloom.operators import aggregates, text
from wattloom.plans.q_sources import DAILY
from wattloom.plans.registry import query
from wattloom.plans.views import START, Tables


@query("hourly_building_series", "SELECT * FROM v_series", ("v_series",))
def _(t: Tables) -> DataFrame:
    return t.series()


@query("energy_metrics", f"""
SELECT building_id, {r("sum(meter_reading_kwh)", 1)} AS total_consumption_kwh, {r("max(meter_reading_kwh)", 1)} AS peak_demand_kw,
  {r("sum(predicted_kwh)", 1)} AS predicted_baseline_kwh, count(*) FILTER (WHERE is_anomaly) AS total_anomalies_detected,
  {r("w", 1).replace("(w)", "(sum(CASE WHEN is_anomaly THEN greatest(residual, 0) ELSE 0 END))")} AS estimated_waste_kwh,
  {r("sum(CASE WHEN is_anomaly THEN greatest(residual, 0) ELSE 0 END) * 3100", 0)} AS estimated_waste_cost_vnd,
  {r("sum(CASE WHEN is_anomaly THEN greatest(residual, 0) ELSE 0 END) * 0.125", 2)} AS estimated_waste_cost_usd
FROM v_scored GROUP BY 1""", ("v_scored",))
def _(t: Tables) -> DataFrame:
    return aggregates.energy_metrics(t.scored())


WASTE = "coalesce(TRY_CAST(json_extract_string(snapshot, '$.estimated_waste_vnd') AS DOUBLE), 0)"


@query("live_energy_metrics", f"""
SELECT s.building_id, s.total_consumption_kwh, s.peak_demand_kw, coalesce(e.n, 0) AS total_anomalies_detected,
  {r("coalesce(e.vnd, 0)", 0)} AS estimated_waste_cost_vnd, {r("0.0", 2)} AS estimated_waste_cost_usd
FROM (SELECT building_id, {r("sum(meter_reading_kwh)", 1)} AS total_consumption_kwh, {r("max(meter_reading_kwh)", 1)} AS peak_demand_kw FROM v_series GROUP BY 1 HAVING count(*) >= 24) s
LEFT JOIN (SELECT building_id, count(*) AS n, sum({WASTE}) AS vnd FROM v_incident WHERE status <> 'IGNORED' AND timestamp >= {START} GROUP BY 1) e
  ON e.building_id = s.building_id""", ("v_series", "v_incident", "v_span"))
def _(t: Tables) -> DataFrame:
    return aggregates.live_energy_metrics(t.series(), t("v_incident"), t.span()[0])


MONTHLY = f"""
SELECT building_id, strftime(m, '%Y-%m') AS month, total AS total_consumption_kwh, coalesce({r("total / days", 2)}, 0) AS average_daily_kwh, coalesce(peak, 0) AS peak_demand_kw,
  coalesce(n, 0) AS reading_count, {r("CASE WHEN prev > 0 THEN (total - prev) / prev * 100 END", 1)} AS change_vs_previous_month_pct
FROM (SELECT *, lag(total) OVER (PARTITION BY building_id ORDER BY m) AS prev FROM (
  SELECT s.building_id, s.m, coalesce(a.total, 0) AS total, a.peak, a.n, a.days
  FROM (SELECT building_id, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m
        FROM (SELECT building_id, min(date_trunc('month', CAST(timestamp AS TIMESTAMP))) AS lo, max(date_trunc('month', CAST(timestamp AS TIMESTAMP))) AS hi FROM v_daily_meter GROUP BY 1) b) s
  LEFT JOIN (SELECT building_id, date_trunc('month', CAST(timestamp AS TIMESTAMP)) AS m, {r("sum(coalesce(meter_reading, 0))", 2)} AS total, {r("max(coalesce(meter_reading, 0))", 2)} AS peak,
               count(*) AS n, count(DISTINCT CAST(timestamp AS DATE)) AS days FROM v_daily_meter GROUP BY 1, 2) a ON a.building_id = s.building_id AND a.m = s.m) q) w"""


@query("monthly_summary", MONTHLY, ("v_daily_meter",))
def _(t: Tables) -> DataFrame:
    return aggregates.monthly_summary(t("v_daily_meter"))


@query("daily_breakdown", DAILY, ("v_daily_meter",))
def _(t: Tables) -> DataFrame:
    return aggregates.daily_breakdown(t("v_daily_meter"))


@query("severity_breakdown", f"""
SELECT building_id, upper(coalesce(severity, 'UNKNOWN')) AS severity, count(*) AS incidents, {r(f"sum({WASTE})", 0)} AS estimated_waste_vnd FROM v_incident GROUP BY 1, 2""", ("v_incident",))
def _(t: Tables) -> DataFrame:
    return aggregates.severity_breakdown(t("v_incident"))


@query("monthly_report", f"""
SELECT m.*, m.building_id || '-' || m.month AS report_id, d.days, d.last_day, coalesce(s.anomaly_count, 0) AS anomaly_count, coalesce(s.vnd, 0.0) AS estimated_waste_vnd, coalesce(s.breakdown, '') AS breakdown
FROM ({MONTHLY}) m
LEFT JOIN (SELECT building_id, substr(day, 1, 7) AS month, count(*) AS days, max(day) AS last_day FROM ({DAILY}) x GROUP BY 1, 2) d ON d.building_id = m.building_id AND d.month = m.month
LEFT JOIN (SELECT building_id, month, CAST(sum(n) AS BIGINT) AS anomaly_count, sum(v) AS vnd, string_agg(severity || '=' || n, ',' ORDER BY severity) AS breakdown
  FROM (SELECT 'c' || CAST(CAST(substr(building_id, 2, 10) AS BIGINT) + id % 50 AS STRING) AS building_id, month, severity, count(*) AS n, {r("sum(v)", 0)} AS v
        FROM (SELECT building_id, seq AS id, strftime(timestamp - INTERVAL 1096 DAY * 2, '%Y-%m') AS month, upper(coalesce(severity, 'UNKNOWN')) AS severity, {WASTE} AS v FROM v_incident) i GROUP BY 1, 2, 3) j
  GROUP BY 1, 2) s ON s.building_id = m.building_id AND s.month = m.month""", ("v_daily_meter", "v_incident"))
def _(t: Tables) -> DataFrame:
    # incidents are moved onto the buildings and the years of the daily meters
    building = F.concat(F.lit("c"), (F.substring("building_id", 2, 10).cast("long") + F.col("seq") % 50).cast("string"))
    incidents = t("v_incident").withColumn("building_id", building).withColumn(
        "timestamp", F.col("timestamp") - F.expr("interval 2192 days")
    )
    report = aggregates.monthly_report(t("v_daily_meter"), incidents)
    pairs = F.transform(F.map_entries("anomaly_breakdown"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return (
        report.withColumn("days", F.size("daily").cast("long")).withColumn("last_day", F.element_at("daily", -1).day)
        .withColumn("breakdown", F.array_join(F.array_sort(pairs), ",")).drop("daily", "anomaly_breakdown")
    )


@query("forecast_summary", f"""
SELECT f.building_id, f.predicted_kwh AS expected_peak_kw, f.timestamp AS peak_timestamp, a.m AS average_forecast_kwh, {r("f.lower_bound_95", 1)} AS peak_lower, {r("f.upper_bound_95", 1)} AS peak_upper
FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY predicted_kwh DESC, timestamp) AS n FROM v_forecast) f
JOIN (SELECT building_id, {r("avg(predicted_kwh)", 1)} AS m FROM v_forecast GROUP BY 1) a ON a.building_id = f.building_id WHERE f.n = 1""", ("v_forecast",))
def _(t: Tables) -> DataFrame:
    return aggregates.forecast_summary(t.forecast())


@query("peak_time", """
SELECT building_id, timestamp AS peak_timestamp, meter_reading AS peak_kwh FROM (
  SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY meter_reading DESC NULLS LAST, timestamp) AS n FROM v_hourly) q WHERE n = 1""", ("v_hourly",))
def _(t: Tables) -> DataFrame:
    return aggregates.peak_time(t.hourly())


@query("hour_profile", "SELECT building_id, CAST(dayofweek AS BIGINT) AS dayofweek, CAST(hour AS BIGINT) AS hour, profile_kwh FROM v_profile", ("v_profile",))
def _(t: Tables) -> DataFrame:
    return t.profile()


@query("sparkline_stats", f"""
SELECT meter_id, count(*) AS points, {r("avg(coalesce(meter_reading_kwh, 0))", 4)} AS mean_kwh, min(coalesce(meter_reading_kwh, 0)) AS min_kwh, max(coalesce(meter_reading_kwh, 0)) AS max_kwh
FROM (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY timestamp DESC, id DESC) AS n FROM v_meter_reading) q WHERE n <= 24 GROUP BY 1 HAVING count(*) >= 2""", ("v_meter_reading",))
def _(t: Tables) -> DataFrame:
    return aggregates.sparkline_stats(t("v_meter_reading"))


@query("incident_status_counts", """
SELECT building_id, count(*) FILTER (WHERE s = 'OPEN') AS open, count(*) FILTER (WHERE s = 'ACKNOWLEDGED') AS acknowledged, count(*) FILTER (WHERE s = 'RESOLVED') AS resolved,
  count(*) FILTER (WHERE s = 'IGNORED') AS ignored FROM (SELECT building_id, coalesce(status, 'OPEN') AS s FROM v_incident) q GROUP BY 1""", ("v_incident",))
def _(t: Tables) -> DataFrame:
    return aggregates.incident_status_counts(t("v_incident"))


INTENT_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(user_query), '{w}')" for w in words) + f" THEN '{name}'" for name, words in S.INTENT_WORDS.items()
) + f" ELSE '{S.OTHER_INTENT}' END"


def words_sql(column: str) -> str:
    return f"(CASE WHEN trim(regexp_replace({column}, '^\\s+|\\s+$', '', 'g')) = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace({column}, '^\\s+|\\s+$', '', 'g'), '\\s+')) END)"


ENRICHED = f"""
SELECT log_id, turn, intent, prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens,
  (has_metrics OR has_forecast) AND regexp_matches(full_response, '[0-9]') AS is_grounded,
  CASE WHEN length(full_response) > 200 THEN substring(full_response, 1, 200) || '...' ELSE full_response END AS response_snippet, has_metrics, has_forecast, latency_ms
FROM (SELECT *, {INTENT_SQL} AS intent, CAST(floor({words_sql('user_query')} * 1.3) AS BIGINT) + 150 AS prompt_tokens,
        CAST(floor({words_sql('full_response')} * 1.3) AS BIGINT) AS completion_tokens,
        contains(lower(user_query), 'on') AS has_metrics, contains(lower(user_query), 'th') AS has_forecast FROM v_interaction) q"""


def enriched(t: Tables) -> DataFrame:
    lowered = F.lower("user_query")
    tools = F.array_compact(
        F.array(F.when(lowered.contains("on"), F.lit("get_metrics")), F.when(lowered.contains("th"), F.lit("query_forecast")))
    )
    return text.interaction_enrich(t("v_interaction").withColumn("tools_called", tools))


@query("interaction_enrich", f"SELECT log_id, turn, intent, prompt_tokens, completion_tokens, total_tokens, is_grounded, response_snippet FROM ({ENRICHED}) e", ("v_interaction",))
def _(t: Tables) -> DataFrame:
    return enriched(t).select("log_id", "turn", "intent", "prompt_tokens", "completion_tokens", "total_tokens", "is_grounded", "response_snippet")


@query("interaction_stats", f"""
SELECT count(*) AS total_queries, coalesce({r("avg(latency_ms)", 2)}, 0) AS average_latency_ms, coalesce({r("avg(CASE WHEN is_grounded THEN 1.0 ELSE 0.0 END)", 4)}, 0) AS grounded_ratio,
  (SELECT string_agg(intent || '=' || n, ',' ORDER BY intent) FROM (SELECT intent, count(*) AS n FROM ({ENRICHED}) a GROUP BY 1) b) AS intents,
  concat('get_metrics=', count(*) FILTER (WHERE has_metrics), ',query_forecast=', count(*) FILTER (WHERE has_forecast)) AS tools
FROM ({ENRICHED}) e""", ("v_interaction",))
def _(t: Tables) -> DataFrame:
    from wattloom.session import scratch

    path = scratch(t.spark, "interactions")
    enriched(t).select("intent", "latency_ms", "tools_called", "is_grounded").write.json(path)
    stats = aggregates.interaction_stats(aggregates.read_interaction_log(t.spark, path))

    def shown(column: str):
        pairs = F.transform(F.map_entries(column), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
        return F.array_join(F.array_sort(pairs), ",")

    return stats.select(
        "total_queries", "average_latency_ms", "grounded_ratio",
        shown("intents_distribution").alias("intents"), shown("tool_usage_counts").alias("tools"),
    )
