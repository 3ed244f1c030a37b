"""Forecast evaluation, model choice, drift and savings on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from wattloom.functions.numeric import sql_round as r
from wattloom.operators import drift, evaluation, forecast, scenarios
from wattloom.plans.q_sources import all_predictions, evaluation_tables
from wattloom.plans.registry import query
from wattloom.plans.views import Tables
from wattloom.session import cut_lineage


@query("seasonal_naive", """
SELECT building_id, timestamp, meter_reading, prediction FROM (SELECT *, lag(meter_reading, 24) OVER (PARTITION BY building_id ORDER BY timestamp) AS prediction FROM v_clean) q WHERE prediction IS NOT NULL""", ("v_clean",))
def _(t: Tables) -> DataFrame:
    return evaluation.seasonal_naive(t.clean()).select("building_id", "timestamp", "meter_reading", "prediction")


@query("forecast_metrics", "SELECT * FROM v_result", ("v_result",))
def _(t: Tables) -> DataFrame:
    return evaluation.forecast_metrics(all_predictions(t).filter(F.col("horizon_h") == 1), "model")


QUANTILES_SQL = """SELECT s.*, q.lo, q.mid, q.hi FROM v_split s JOIN (
  SELECT building_id, hour, quantile_cont(meter_reading, 0.025) AS lo, quantile_cont(meter_reading, 0.5) AS mid, quantile_cont(meter_reading, 0.975) AS hi FROM v_split WHERE part = 'train' GROUP BY 1, 2) q
  ON q.building_id = s.building_id AND q.hour = s.hour WHERE s.part = 'test'"""


def hourly_quantiles(t: Tables) -> DataFrame:
    """Test rows with the training quantiles of their hour as a learned band."""
    split = t.kept_split()
    levels = F.percentile("meter_reading", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    fitted = split.filter(F.col("part") == "train").groupBy("building_id", "hour").agg(levels.alias("_q"))
    joined = split.filter(F.col("part") == "test").join(fitted, ["building_id", "hour"])
    return joined.withColumns({n: F.get("_q", F.lit(i)) for i, n in enumerate(["q_low", "q_mid", "q_high"])}).drop("_q")


def pin(column: str, q: float) -> str:
    return f"avg(CASE WHEN meter_reading - {column} >= 0 THEN (meter_reading - {column}) * {q} ELSE (meter_reading - {column}) * ({q} - 1) END)"


@query("pinball_coverage", f"""
SELECT building_id, {r(pin("lo", 0.025), 4)} AS pinball_q2_5, {r(pin("mid", 0.5), 4)} AS pinball_q50, {r(pin("hi", 0.975), 4)} AS pinball_q97_5,
  {r("avg(CASE WHEN meter_reading BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END)", 4)} AS coverage_95, {r("avg(hi - lo)", 4)} AS mean_width FROM ({QUANTILES_SQL}) b GROUP BY 1""", ("v_split",))
def _(t: Tables) -> DataFrame:
    return evaluation.pinball_coverage(hourly_quantiles(t).withColumn("actual", F.col("meter_reading")), "building_id")


@query("horizon_scoring", "SELECT model, CAST(horizon_h AS BIGINT) AS horizon_h, mae, rmse FROM v_by_horizon", ("v_by_horizon",))
def _(t: Tables) -> DataFrame:
    return evaluation.horizon_scoring(all_predictions(t))


BANDS_SQL = f"""
SELECT p.horizon_h, p.actual, greatest(0.0, least(b.lo, p.prediction)) AS l1, greatest(b.hi, p.prediction) AS h1, greatest(0.0, p.prediction - m.half) AS l2, p.prediction + m.half AS h2
FROM v_prediction p JOIN ({QUANTILES_SQL}) b ON b.building_id = p.building_id AND b.timestamp = p.target_timestamp,
  (SELECT 1.96 * rmse AS half FROM v_result WHERE model = 'seasonal_arx') m WHERE p.model = 'seasonal_arx'"""


@query("interval_coverage", f"""
SELECT horizon_h, method, {r("avg(hit)", 6)} AS coverage, {r("avg(width)", 4)} AS mean_width FROM (
  SELECT CAST(h AS BIGINT) AS horizon_h, method, hit, width FROM (
    SELECT horizon_h, 'learned_quantile' AS method, CASE WHEN actual BETWEEN l1 AND h1 THEN 1.0 ELSE 0.0 END AS hit, h1 - l1 AS width FROM ({BANDS_SQL}) x
    UNION ALL SELECT horizon_h, 'fixed_rmse', CASE WHEN actual BETWEEN l2 AND h2 THEN 1.0 ELSE 0.0 END, h2 - l2 FROM ({BANDS_SQL}) y) u, LATERAL (SELECT unnest([0, horizon_h]) AS h) k) z
GROUP BY 1, 2""", ("v_prediction", "v_result", "v_split"))
def _(t: Tables) -> DataFrame:
    # the trained model's recursive forecasts; the constant band is its error one hour ahead
    split = t.kept_split()
    fitted = forecast.arx_fit(split.filter(F.col("part") == "train"))
    made = cut_lineage(forecast.arx_horizons(split.filter(F.col("part") == "test"), fitted), "horizons")
    first = evaluation.forecast_metrics(made.filter(F.col("horizon_h") == 1), "model").first()
    rmse = first.rmse if first else 0.0
    levels = hourly_quantiles(t).select("building_id", F.col("timestamp").alias("target_timestamp"), "q_low", "q_high")
    return evaluation.interval_coverage(made.join(levels, ["building_id", "target_timestamp"]).withColumn("half_width", F.lit(1.96 * rmse)))


@query("error_by_hour", f"""
SELECT model, hour(target_timestamp) AS hour, {r("avg(abs(actual - prediction))", 4)} AS mean_abs_error FROM v_prediction WHERE horizon_h = 1 GROUP BY 1, 2""", ("v_prediction",))
def _(t: Tables) -> DataFrame:
    return evaluation.error_by_hour(all_predictions(t))


@query("best_at_horizon", """
SELECT 1 AS asked, horizon_h, model, mae FROM (SELECT CAST(horizon_h AS BIGINT) AS horizon_h, model, mae, row_number() OVER (ORDER BY mae, model) AS n FROM v_by_horizon WHERE horizon_h = 1) a WHERE n = 1
UNION ALL SELECT CAST(48 AS BIGINT), horizon_h, model, mae FROM (SELECT CAST(horizon_h AS BIGINT) AS horizon_h, model, mae, row_number() OVER (ORDER BY mae, model) AS n FROM v_by_horizon WHERE horizon_h = 24) b WHERE n = 1""", ("v_by_horizon",))
def _(t: Tables) -> DataFrame:
    _, _, by_horizon = evaluation_tables(t)
    near = evaluation.best_at_horizon(by_horizon, 1).withColumn("asked", F.lit(1))
    far = evaluation.best_at_horizon(by_horizon, 48).withColumn("asked", F.lit(48))
    return near.unionByName(far)


@query("model_recommendation", f"""
SELECT model, mean_mae, latency_ms, size_bytes, rank, is_contender, is_contender AND row_number() OVER (ORDER BY is_contender DESC, latency_ms, size_bytes, model) = 1 AS recommended
FROM (SELECT *, row_number() OVER (ORDER BY mean_mae, latency_ms, size_bytes, model) AS rank, mean_mae <= min(mean_mae) OVER () * (1 + 0.01) AS is_contender FROM (
  SELECT model, {r("avg(mae)", 6)} AS mean_mae, length(model) * CAST(0.001 AS DOUBLE) AS latency_ms, length(model) * 100 AS size_bytes FROM v_by_horizon GROUP BY 1) a) b""", ("v_by_horizon",))
def _(t: Tables) -> DataFrame:
    _, results, by_horizon = evaluation_tables(t)
    cost = results.select(
        "model", (F.length("model") * F.lit(0.001)).alias("latency_ms"), (F.length("model") * 100).cast("long").alias("size_bytes")
    )
    return evaluation.model_recommendation(by_horizon, cost)


@query("holdout_mape", f"""
SELECT building_id, count(*) FILTER (WHERE actual <> 0) AS rows_used, {r("avg(CASE WHEN actual <> 0 THEN abs((actual - prediction) / actual) END) * 100", 6)} AS mape_percent, CAST(NULL AS STRING) AS error
FROM (SELECT building_id, CASE WHEN hour = 3 THEN 0.0 ELSE meter_reading END AS actual, profile_kwh AS prediction FROM v_test) q GROUP BY 1""", ("v_test",))
def _(t: Tables) -> DataFrame:
    test = t.with_profile().filter(F.col("part") == "test").select(
        "building_id", F.when(F.col("hour") == 3, F.lit(0.0)).otherwise(F.col("meter_reading")).alias("actual"),
        F.col("profile_kwh").alias("prediction"),
    )
    return evaluation.holdout_mape(test, "building_id")


ROLLING_SQL = f"""
SELECT building_id, {r("avg(abs((meter_reading - profile_kwh) / meter_reading)) * 100", 2)} AS mape_percent, count(*) AS window_rows FROM (
  SELECT s.*, p.profile_kwh, row_number() OVER (PARTITION BY s.building_id ORDER BY s.timestamp DESC) AS newest FROM v_split s JOIN v_profile p ON p.building_id = s.building_id AND p.dayofweek = s.dayofweek AND p.hour = s.hour) q
WHERE newest <= 168 GROUP BY 1"""


def scored_pairs(t: Tables) -> DataFrame:
    return t.with_profile().select(
        "building_id", "timestamp", "part", F.col("meter_reading").alias("actual"), F.col("profile_kwh").alias("prediction"), "lag_24h"
    )


@query("rolling_mape", ROLLING_SQL, ("v_split", "v_profile"))
def _(t: Tables) -> DataFrame:
    return evaluation.rolling_mape(scored_pairs(t))


GATE_SQL = f"""
SELECT building_id, CASE WHEN failed IS NULL THEN champion END AS champion_mape, CASE WHEN failed IS NULL THEN challenger END AS challenger_mape,
  CASE WHEN failed IS NOT NULL THEN 'failed' WHEN challenger < champion THEN 'promoted' ELSE 'rejected' END AS outcome,
  coalesce(failed, CASE WHEN NOT challenger < champion THEN concat('Challenger MAPE (', printf('%.6f', {r("challenger", 6)}), '%) is not strictly lower than champion MAPE (', printf('%.6f', {r("champion", 6)}), '%).') END) AS reason
FROM (SELECT building_id, {r("avg(abs((meter_reading - lag_24h) / meter_reading)) * 100", 6)} AS champion, {r("avg(abs((meter_reading - profile_kwh) / meter_reading)) * 100", 6)} AS challenger,
        CASE WHEN building_id = 'b3' THEN 'Temporal leakage detected: holdout window must start strictly after active champion training cutoff.' END AS failed FROM v_test GROUP BY 1) q"""


def gate(t: Tables) -> DataFrame:
    split = scored_pairs(t)
    holdout = split.filter(F.col("part") == "test").select(
        "building_id", "timestamp", "actual", F.col("lag_24h").alias("champion"), F.col("prediction").alias("challenger")
    )
    trained = split.filter(F.col("part") == "train").groupBy("building_id").agg(F.max("timestamp").alias("train_end"))
    bounds = trained.withColumn(
        "champion_train_end",
        F.when(F.col("building_id") == "b3", F.lit(t.span()[1]).cast("timestamp_ntz")).otherwise(F.col("train_end")),
    )
    return evaluation.champion_gate(holdout, bounds)


@query("champion_gate", GATE_SQL, ("v_test",))
def _(t: Tables) -> DataFrame:
    return gate(t)


# drift


COLUMNS = ["meter_reading", "air_temperature"]
SAMPLE_SQL = """(SELECT building_id, "column", value, is_reference FROM (
  SELECT building_id, 'meter_reading' AS "column", meter_reading AS value, part = 'train' AS is_reference FROM v_split
  UNION ALL SELECT building_id, 'air_temperature', air_temperature, part = 'train' FROM v_split) u)"""

PSI_SQL = f"""
SELECT building_id, "column", {r("sum((n - r) * ln(n / r))", 6)} AS psi FROM (
  SELECT building_id, "column", b, count(*) FILTER (WHERE is_reference) / max(nr) + 0.0001 AS r, count(*) FILTER (WHERE NOT is_reference) / max(nn) + 0.0001 AS n FROM (
    SELECT s.building_id, s."column", s.is_reference, e.nr, e.nn, len(list_filter(e.inner_edges, lambda x: x <= s.value)) AS b FROM {SAMPLE_SQL} s JOIN (
      SELECT building_id, "column", nr, nn, CASE WHEN len(list_distinct(q)) < 11 THEN [lo + (hi - lo) / 10 * i for i in [1, 2, 3, 4, 5, 6, 7, 8, 9]] ELSE q[2:10] END AS inner_edges FROM (
        SELECT building_id, "column", quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FILTER (WHERE is_reference) AS q, min(value) FILTER (WHERE is_reference) AS lo,
          max(value) FILTER (WHERE is_reference) AS hi, count(*) FILTER (WHERE is_reference) AS nr, count(*) FILTER (WHERE NOT is_reference) AS nn FROM {SAMPLE_SQL} v GROUP BY 1, 2) w) e
      ON e.building_id = s.building_id AND e."column" = s."column") t GROUP BY 1, 2, 3) z GROUP BY 1, 2"""

KS_SQL = f"""
SELECT building_id, "column", {r("d", 6)} AS ks_statistic,
  {r("CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum([CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * lam * lam) for k in range(1, 101)]))) END", 6)} AS p_value,
  ref_n, rec_n, false AS insufficient_data FROM (
  SELECT *, sqrt(ref_n * rec_n / (ref_n + rec_n)) * d AS lam FROM (
    SELECT building_id, "column", max(abs(cr / tr - cn / tn)) AS d, max(tr) AS ref_n, max(tn) AS rec_n FROM (
      SELECT building_id, "column", CAST(sum(rr) OVER o AS BIGINT) AS cr, CAST(sum(nn) OVER o AS BIGINT) AS cn, CAST(sum(rr) OVER w AS BIGINT) AS tr, CAST(sum(nn) OVER w AS BIGINT) AS tn FROM (
        SELECT building_id, "column", value, count(*) FILTER (WHERE is_reference) AS rr, count(*) FILTER (WHERE NOT is_reference) AS nn FROM {SAMPLE_SQL} s GROUP BY 1, 2, 3) a
      WINDOW o AS (PARTITION BY building_id, "column" ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w AS (PARTITION BY building_id, "column")) b GROUP BY 1, 2) c) d"""

DRIFT_SQL = f"""
SELECT building_id, mape_percent, nullif(concat_ws(',', CASE WHEN m_p < 0.05 AND m_psi > 0.2 THEN 'meter_reading' END, CASE WHEN t_p < 0.05 AND t_psi > 0.2 THEN 'air_temperature' END, CASE WHEN mape_percent > 15 THEN 'rolling_mape' END), '') AS triggered
FROM (SELECT k.building_id, max(r.mape_percent) AS mape_percent, max(CASE WHEN k."column" = 'meter_reading' THEN p_value END) AS m_p, max(CASE WHEN k."column" = 'meter_reading' THEN psi END) AS m_psi,
        max(CASE WHEN k."column" = 'air_temperature' THEN p_value END) AS t_p, max(CASE WHEN k."column" = 'air_temperature' THEN psi END) AS t_psi
      FROM ({KS_SQL}) k JOIN ({PSI_SQL}) p ON p.building_id = k.building_id AND p."column" = k."column" JOIN ({ROLLING_SQL}) r ON r.building_id = k.building_id GROUP BY 1) q"""


def both_samples(t: Tables) -> DataFrame:
    split = t.kept_split()
    return drift.samples(split.filter(F.col("part") == "train"), split.filter(F.col("part") == "test"), COLUMNS)


@query("psi", PSI_SQL, ("v_split",))
def _(t: Tables) -> DataFrame:
    return drift.psi(both_samples(t))


@query("ks_two_sample", KS_SQL, ("v_split",))
def _(t: Tables) -> DataFrame:
    return drift.ks_two_sample(both_samples(t))


def drift_rows(t: Tables) -> DataFrame:
    split = t.kept_split()
    train, test = split.filter(F.col("part") == "train"), split.filter(F.col("part") == "test")
    return drift.drift_check(train, test, evaluation.rolling_mape(scored_pairs(t)), COLUMNS)


@query("drift_check", f"SELECT building_id, mape_percent, coalesce(triggered, '') AS triggered, triggered IS NOT NULL AS drift_detected, CAST(0.05 AS DOUBLE) AS ks_pvalue_limit FROM ({DRIFT_SQL}) d", ("v_split", "v_profile"))
def _(t: Tables) -> DataFrame:
    return drift_rows(t).select(
        "building_id", "mape_percent", F.array_join("triggered_signals", ",").alias("triggered"), "drift_detected",
        F.col("thresholds.ks_pvalue").alias("ks_pvalue_limit"),
    )


@query("retrain_trigger", f"""
SELECT building_id, triggered IS NOT NULL AND building_id <> 'b1' AS retrain_triggered, CASE WHEN triggered IS NOT NULL AND building_id <> 'b1' THEN CASE WHEN triggered = 'rolling_mape' THEN 'mape' ELSE 'drift' END END AS retrain_trigger,
  CASE WHEN triggered IS NOT NULL AND building_id = 'b1' THEN 'retrain_already_running' END AS retrain_skipped_reason FROM ({DRIFT_SQL}) d""", ("v_split", "v_profile"))
def _(t: Tables) -> DataFrame:
    running = t("v_telemetry").select("building_id").distinct().filter(F.col("building_id") == "b1")
    return drift.retrain_trigger(drift_rows(t), running).select("building_id", "retrain_triggered", "retrain_trigger", "retrain_skipped_reason")


@query("model_status", f"""
SELECT least(3, (SELECT count(DISTINCT building_id) FROM v_test)) AS runs, (SELECT max(building_id) FROM v_test) AS newest_run, (SELECT model FROM v_result ORDER BY mae, model LIMIT 1) AS champion,
  (SELECT CAST(count(*) FILTER (WHERE triggered IS NOT NULL) AS BIGINT) FROM ({DRIFT_SQL}) d) AS drifted, true AS quality_missing, true AS benchmark_missing, 'benchmark' AS bad_sections""", ("v_result", "v_split", "v_profile", "v_test"))
def _(t: Tables) -> DataFrame:
    # sections are the JSON of other results; the benchmark one is cut short on purpose
    champion = evaluation.forecast_metrics(all_predictions(t).filter(F.col("horizon_h") == 1), "model")
    payload = champion.groupBy(F.lit("champion").alias("section")).agg(F.to_json(F.min_by(F.struct("model", "mae", "r2"), F.struct("mae", "model"))).alias("payload"))
    drifted = drift_rows(t).groupBy(F.lit("drift").alias("section")).agg(F.to_json(F.struct(F.count_if("drift_detected").alias("mae"))).alias("payload"))
    broken = payload.select(F.lit("benchmark").alias("section"), F.expr("substring(payload, 1, 12)").alias("payload"))
    from wattloom.sources.files import strict_json_rows

    sections = strict_json_rows(payload.unionByName(drifted).unionByName(broken), "payload", "mae DOUBLE")
    runs = gate(t).select(
        F.col("building_id").alias("run_id"), F.lit("2024-01-31T00:00:00Z").alias("timestamp"), "outcome", "champion_mape", "challenger_mape"
    )
    status = drift.model_status(sections, runs, newest=3)
    return status.select(
        F.size("retrain_history").alias("runs"), F.col("retrain_history")[0].run_id.alias("newest_run"), F.get_json_object("champion", "$.model").alias("champion"),
        F.get_json_object("drift", "$.mae").cast("long").alias("drifted"),
        F.col("anomaly_quality").isNull().alias("quality_missing"), F.col("benchmark").isNull().alias("benchmark_missing"),
        F.array_join(F.map_keys("errors"), ",").alias("bad_sections"),
    )


# savings

ASKED_SQL = """SELECT event_id, 'b' || CAST(user_id % 4 AS STRING) AS building_id, (event_id % 11) * CAST(0.25 AS DOUBLE) AS d, (event_id % 10) * CAST(0.5 AS DOUBLE) AS o, (event_id % 19) * CAST(0.05 AS DOUBLE) AS s FROM events"""


def asked(t: Tables) -> DataFrame:
    """One scenario per event, valid and invalid ones, each for a building."""
    i = F.col("event_id")
    return t.base("events").select(
        "event_id", i.cast("string").alias("scenario"), F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("building_id"),
        (i % 11 * 0.25).alias("setpoint_delta_c"), (i % 10 * 0.5).alias("off_hours"), (i % 19 * 0.05).alias("hvac_share"),
    )


@query("scenario_validate", f"""
SELECT event_id, CASE WHEN NOT d BETWEEN 0 AND 2 OR (d * 2) % 1 <> 0 THEN 'setpoint_delta_c' WHEN NOT o BETWEEN 0 AND 3 OR o % 1 <> 0 THEN 'off_hours' WHEN NOT s BETWEEN 0.05 AND 0.8 THEN 'hvac_share' END AS reason
FROM ({ASKED_SQL}) q""")
def _(t: Tables) -> DataFrame:
    return scenarios.scenario_validate(asked(t)).select("event_id", "reason")


SAVING_SQL = f"""
SELECT *, CASE WHEN lh >= 18 - o AND lh < 18 THEN predicted_kwh * s WHEN lh >= 7 AND lh < 18 THEN predicted_kwh * s * d * 0.06 ELSE 0.0 END AS low,
  CASE WHEN lh >= 18 - o AND lh < 18 THEN predicted_kwh * s WHEN lh >= 7 AND lh < 18 THEN predicted_kwh * s * d * 0.08 ELSE 0.0 END AS high
FROM (SELECT f.building_id, f.timestamp, f.predicted_kwh, CAST(p.event_id AS STRING) AS scenario, d, o, s, (hour(f.timestamp) + 7) % 24 AS lh FROM v_forecast f JOIN ({ASKED_SQL}) p ON p.building_id = f.building_id
  WHERE d BETWEEN 0 AND 2 AND (d * 2) % 1 = 0 AND o BETWEEN 0 AND 3 AND o % 1 = 0 AND s BETWEEN 0.05 AND 0.8) q"""


@query("scenario_savings_hourly", f"""
SELECT building_id, scenario, timestamp, lh AS local_hour, {r("predicted_kwh - high", 2)} AS scenario_low_kwh, {r("predicted_kwh - low", 2)} AS scenario_high_kwh FROM ({SAVING_SQL}) h""", ("v_forecast",))
def _(t: Tables) -> DataFrame:
    return scenarios.scenario_savings_hourly(t.forecast(), asked(t)).select(
        "building_id", "scenario", "timestamp", "local_hour", "scenario_low_kwh", "scenario_high_kwh"
    )


def triple(name: str, expression: str) -> str:
    return f"{r(expression, 2)} AS {name}_kwh, {r(f'{expression} * 3100', 0)} AS {name}_vnd, {r(f'{expression} * 0.6766', 2)} AS {name}_co2_kg"


@query("scenario_savings_total", f"""
SELECT building_id, scenario, {triple("baseline", "sum(predicted_kwh)")}, {triple("low", "sum(low)")}, {triple("high", "sum(high)")}, CAST(NULL AS STRING) AS note FROM ({SAVING_SQL}) h GROUP BY 1, 2""", ("v_forecast",))
def _(t: Tables) -> DataFrame:
    return scenarios.scenario_savings_total(scenarios.scenario_savings_hourly(t.forecast(), asked(t)))
