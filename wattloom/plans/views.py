"""The given tables seen as telemetry, occupancy, incidents and documents.

Every view is one SQL text that both engines read, so a query and its twin
start from the same definition. Views that an operator produces (the hourly
series and what follows from it) are SQL for the twin only; the Spark side
builds them with the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.numeric import sql_round as r
from wattloom.operators import aggregates, cleaning, features, forest
from wattloom.session import cut_lineage

#: First and last hour of the days that readings span, and the hour after them, in SQL.
START = "(SELECT first_hour FROM v_span)"
LAST_HOUR = "(SELECT last_hour FROM v_span)"
NOW = "(SELECT last_hour + INTERVAL 1 HOUR FROM v_span)"

#: How the span's hours are written.
S_FORMAT = "yyyy-MM-dd HH:mm:ss"

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# name -> (what it reads, text)
SHARED: dict[str, tuple[list[str], str]] = {
    "v_telemetry": (["events"], """
SELECT event_id AS id, 'b' || CAST(user_id % 4 AS STRING) AS building_id,
  CASE WHEN event_type = 'signup' THEN NULL ELSE 'z_' || event_type END AS zone_id,
  ts AS timestamp, value AS meter_reading_kwh,
  CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(15 AS DOUBLE) + k * CAST(0.2 AS DOUBLE) END AS outdoor_temperature_c,
  CAST(40 + k % 50 AS DOUBLE) AS relative_humidity_pct
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e"""),
    "v_meter_reading": (["v_telemetry"], """
SELECT *, 'meter-' || md5(building_id || ':' || coalesce(zone_id, 'total')) AS meter_id FROM v_telemetry"""),
    "v_span": (["events"], """
SELECT date_trunc('day', min(ts)) AS first_hour, date_trunc('day', max(ts)) + INTERVAL 23 HOUR AS last_hour FROM events"""),
    "v_building": (["customer"], """
SELECT 'c' || CAST(c_custkey AS STRING) AS building_id, c_nationkey AS site_id, c_name AS name,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'Office' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Residential' ELSE c_mktsegment END AS building_type,
  c_acctbal AS total_area_sqm FROM customer"""),
    "v_daily_meter": (["orders"], """
SELECT 'c' || CAST(o_custkey AS STRING) AS building_id, o_orderdate AS timestamp, o_orderkey AS seq,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderpriority = '5-LOW' AND o_orderkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice END AS meter_reading
FROM orders"""),
    "v_weather": (["lineitem", "supplier"], """
SELECT s_nationkey AS site_id, l_shipdate AS timestamp, l_quantity AS air_temperature,
  l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""),
    "v_household": (["orders"], """
SELECT o_orderkey AS household_id, o_custkey AS unit_id, o_orderdate AS starts_at,
  lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ends_at FROM orders"""),
    "v_unit": (["customer"], """
SELECT c_custkey AS unit_id, c_nationkey AS building_id, c_acctbal >= 0 AS active FROM customer"""),
    "v_unit_meter": (["v_unit"], """
SELECT unit_id, building_id, CASE WHEN unit_id % 11 = 0 THEN 'BUILDING_TOTAL' WHEN unit_id % 5 = 0 THEN 'COMMON' ELSE 'UNIT' END AS scope FROM v_unit"""),
    "v_unit_reading": (["lineitem", "orders"], """
SELECT o_custkey AS unit_id, l_shipdate AS timestamp, l_quantity AS meter_reading_kwh
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "v_incident": (["v_meter_reading"], """
SELECT 'ANOM-' || md5(CAST(id AS STRING)) AS id, building_id, meter_id, timestamp, meter_reading_kwh AS actual_reading,
  CASE WHEN meter_reading_kwh >= 100 THEN 'CRITICAL' WHEN meter_reading_kwh >= 70 THEN 'MEDIUM' ELSE NULL END AS severity,
  CASE id % 5 WHEN 0 THEN 'ACKNOWLEDGED' WHEN 1 THEN 'RESOLVED' WHEN 2 THEN 'IGNORED' WHEN 3 THEN 'OPEN' ELSE NULL END AS status,
  CASE WHEN id % 7 = 0 THEN NULL ELSE '{"estimated_waste_vnd": ' || CAST(CAST(round(meter_reading_kwh * 3100) AS BIGINT) AS STRING) || ', "predicted_kwh": 50}' END AS snapshot,
  id AS seq
FROM v_meter_reading WHERE meter_reading_kwh >= 50"""),
    # one incident per meter that was open when the first reading came
    "v_open_incident": (["v_meter_reading"], """
SELECT 'ANOM-OLD-' || meter_id AS id, meter_id AS building_id, meter_id, min(timestamp) - INTERVAL 3 MINUTE AS timestamp, min(timestamp) - INTERVAL 1 HOUR AS opened_at,
  CAST(20 AS DOUBLE) AS actual_reading, CAST(0.3 AS DOUBLE) AS anomaly_score, 'MEDIUM' AS severity, 'OPEN' AS status
FROM (SELECT CASE WHEN id % 50 <> 0 THEN building_id END AS meter_id, timestamp FROM v_meter_reading WHERE meter_reading_kwh >= 15) f WHERE meter_id IS NOT NULL GROUP BY meter_id"""),
    "v_labelled": (["labels"], """
SELECT doc_id, toxic AS is_injected_anomaly, 1 - quality AS predicted FROM labels"""),
    "v_kb_document": (["documents"], """
SELECT doc_id, concat('---', chr(10), 'title: ', source, chr(10), 'source: ', lang, chr(10), '---', chr(10), text) AS content FROM documents"""),
    "v_vector_query": (["embeddings"], """
SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0"""),
    "v_turn": (["conversations"], """
SELECT conv_id AS session_id, turn, role, text AS message FROM conversations"""),
    "v_interaction": (["conversations"], """
SELECT u.conv_id AS log_id, u.turn, u.text AS user_query, a.text AS full_response, CAST(length(a.text) AS DOUBLE) AS latency_ms
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'"""),
    "v_member": (["v_household"], """
SELECT household_id * 10 + 1 AS member_id, household_id,
  CASE WHEN household_id % 3 = 0 THEN starts_at + INTERVAL '5' DAY ELSE starts_at END AS starts_at,
  CASE WHEN household_id % 11 = 0 THEN ends_at ELSE NULL END AS ends_at FROM v_household"""),
    "v_unit_incident": (["lineitem", "orders"], """
SELECT concat('UI-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS id,
  o_custkey AS unit_id, l_shipdate AS timestamp, l_quantity AS actual_kwh,
  CASE WHEN l_quantity >= 45 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 7 = 1 THEN '{"predicted_kwh": 20}'
    ELSE concat('{"predicted_kwh": 20, "delta_kwh": ', CAST(CAST(l_quantity AS BIGINT) - 20 AS STRING), ', "estimated_waste_vnd": ', CAST((CAST(l_quantity AS BIGINT) - 20) * 3100 AS STRING), '}') END AS snapshot
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 40"""),
    "v_zone": (["v_telemetry"], """
SELECT DISTINCT building_id, zone_id FROM v_telemetry WHERE zone_id IS NOT NULL
UNION ALL SELECT DISTINCT building_id, 'z_spare' AS zone_id FROM v_telemetry"""),
    # any score beside a reading, for the column rules
    "v_scored_item": (["v_meter_reading"], """
SELECT *, (id % 100 - 99) / CAST(1000 AS DOUBLE) AS anomaly_score FROM v_meter_reading"""),
}


def _arx_weights() -> str:
    """Normal equations of a building's last 336 training rows, solved by elimination."""
    terms = ["1.0", "lag_1h", "lag_24h", "air_temperature"]
    size = len(terms)
    sums = [f"sum({a} * {b}) AS m{i}{j}" for i, a in enumerate(terms) for j, b in enumerate(terms)]
    sums += [f"sum({a} * meter_reading) AS m{i}{size}" for i, a in enumerate(terms)]
    sql = f"""SELECT building_id, {', '.join(sums)} FROM (
      SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY timestamp DESC) AS newest FROM v_split WHERE part = 'train') q WHERE newest <= 336 GROUP BY 1"""
    for k in range(size):
        cells = [
            f"m{i}{j} / m{k}{k} AS m{i}{j}" if i == k else f"m{i}{j} - m{i}{k} * m{k}{j} / m{k}{k} AS m{i}{j}"
            for i in range(size) for j in range(size + 1)
        ]
        sql = f"SELECT building_id, {', '.join(cells)} FROM ({sql}) e{k}"
    return f"SELECT building_id, {', '.join(f'm{i}{size} AS w{i}' for i in range(size))} FROM ({sql}) e"


def _average_path(n: str) -> str:
    return f"(CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2.0 * (ln({n} - 1) + {forest.EULER}) - 2.0 * ({n} - 1) / {n} END)"


def _forest_nodes(rows: str, keep: str = "") -> str:
    """``rows`` with the split of their node: a feature and a threshold, null where the node is a leaf."""
    both = ", ".join(f"min(x[{k}]) OVER w AS a{k}, max(x[{k}]) OVER w AS z{k}" for k in range(1, 10))
    low, high = (", ".join(f"{c}{k}" for k in range(1, 10)) for c in "az")
    chance = lambda first: f"CAST(CAST('0x' || substr(md5('42:' || CAST(tree AS VARCHAR) || ':' || CAST(place AS VARCHAR)), {first}, 13) AS BIGINT) AS DOUBLE) / 4503599627370496"
    return f"""
    SELECT tree, place, depth, {keep}drawn, n, feature, CASE WHEN cut_at >= high[feature + 1] THEN low[feature + 1] ELSE cut_at END AS threshold FROM (
      SELECT *, low[feature + 1] + {chance(17)} * (high[feature + 1] - low[feature + 1]) AS cut_at FROM (
        SELECT *, CASE WHEN depth < ceil(log2(greatest(drawn, 2))) AND n > 1 AND len(usable) > 0 THEN usable[1 + CAST(floor({chance(1)} * len(usable)) AS BIGINT)] END AS feature FROM (
          SELECT *, list_filter(range(9), lambda i: high[i + 1] > low[i + 1]) AS usable FROM (
            SELECT *, [{low}] AS low, [{high}] AS high FROM (
              SELECT *, count(*) OVER w AS n, {both} FROM ({rows}) r0 WINDOW w AS (PARTITION BY tree, place)) r1) r2) r3) r4) r5"""


# Twins of what operators build; DuckDB only.
DERIVED: dict[str, tuple[list[str], str]] = {
    "v_series": (["v_meter_reading", "v_span"], f"""
SELECT building_id, date_trunc('hour', timestamp) AS timestamp,
  {r("coalesce(sum(meter_reading_kwh) FILTER (WHERE zone_id IS NOT NULL), sum(meter_reading_kwh) FILTER (WHERE zone_id IS NULL), 0)", 4)} AS meter_reading_kwh,
  {r("coalesce(avg(outdoor_temperature_c), 26.0)", 2)} AS outdoor_temperature_c
FROM v_meter_reading WHERE timestamp >= {START} AND timestamp < {NOW} GROUP BY 1, 2"""),
    "v_hourly": (["v_series", "v_telemetry", "v_span"], """
SELECT g.building_id, g.timestamp, s.meter_reading_kwh AS meter_reading, s.outdoor_temperature_c AS air_temperature
FROM (SELECT building_id, unnest(generate_series(first_hour, last_hour, INTERVAL 1 HOUR)) AS timestamp
      FROM (SELECT DISTINCT building_id FROM v_telemetry), v_span) g
LEFT JOIN v_series s ON s.building_id = g.building_id AND s.timestamp = g.timestamp"""),
    "v_clean": (["v_hourly"], f"""
SELECT building_id, timestamp, {r("CASE WHEN m IS NOT NULL THEN m WHEN lm IS NULL THEN rm WHEN rm IS NULL THEN lm ELSE lm + (rm - lm) * ((p - lp) / (rp - lp)) END", 2)} AS meter_reading,
  {r("CASE WHEN t IS NOT NULL THEN t WHEN lt IS NULL THEN rt WHEN rt IS NULL THEN lt ELSE lt + (rt - lt) * ((p - ltp) / (rtp - ltp)) END", 2)} AS air_temperature
FROM (
  SELECT building_id, timestamp, m, t, p,
    last_value(m IGNORE NULLS) OVER b AS lm, first_value(m IGNORE NULLS) OVER f AS rm,
    max(CASE WHEN m IS NOT NULL THEN p END) OVER b AS lp, min(CASE WHEN m IS NOT NULL THEN p END) OVER f AS rp,
    last_value(t IGNORE NULLS) OVER b AS lt, first_value(t IGNORE NULLS) OVER f AS rt,
    max(CASE WHEN t IS NOT NULL THEN p END) OVER b AS ltp, min(CASE WHEN t IS NOT NULL THEN p END) OVER f AS rtp
  FROM (SELECT building_id, timestamp, meter_reading AS m, air_temperature AS t,
          CAST(row_number() OVER (PARTITION BY building_id ORDER BY timestamp) AS DOUBLE) AS p FROM v_hourly) x
  WINDOW b AS (PARTITION BY building_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY building_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
) y"""),
    "v_features": (["v_clean"], """
SELECT * FROM (
  SELECT *, hour(timestamp) AS hour, isodow(timestamp) - 1 AS dayofweek, CAST(isodow(timestamp) >= 6 AS BIGINT) AS is_weekend,
    sin(2 * pi() * hour(timestamp) / 24) AS hour_sin, cos(2 * pi() * hour(timestamp) / 24) AS hour_cos,
    lag(meter_reading, 1) OVER w AS lag_1h, lag(meter_reading, 24) OVER w AS lag_24h
  FROM v_clean WINDOW w AS (PARTITION BY building_id ORDER BY timestamp)
) q WHERE lag_24h IS NOT NULL"""),
    "v_split": (["v_features"], """
SELECT *, CASE WHEN position <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM (
  SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY timestamp) AS position, count(*) OVER (PARTITION BY building_id) AS n FROM v_features) q"""),
    "v_profile": (["v_split"], f"""
SELECT s.building_id, s.dayofweek, s.hour, {r("coalesce(k.v, s.overall, 200.0)", 4)} AS profile_kwh
FROM (SELECT building_id, overall, slot // 24 AS dayofweek, slot % 24 AS hour
      FROM (SELECT building_id, median(meter_reading) AS overall FROM v_split WHERE part = 'train' GROUP BY 1) o, range(168) t(slot)) s
LEFT JOIN (SELECT building_id, dayofweek, hour, median(meter_reading) AS v FROM v_split WHERE part = 'train' GROUP BY 1, 2, 3) k
  ON k.building_id = s.building_id AND k.dayofweek = s.dayofweek AND k.hour = s.hour"""),
    "v_test": (["v_split", "v_profile"], """
SELECT t.*, p.profile_kwh FROM v_split t JOIN v_profile p ON p.building_id = t.building_id AND p.dayofweek = t.dayofweek AND p.hour = t.hour
WHERE t.part = 'test'"""),
    "v_pair": (["v_test"], """
SELECT q.building_id, o.timestamp AS origin_timestamp, q.position - o.position AS horizon_h, q.timestamp AS target_timestamp,
  q.meter_reading AS actual, q.lag_24h AS lag24, o.meter_reading AS lag1, q.profile_kwh AS hour_profile
FROM v_test q JOIN v_test o ON o.building_id = q.building_id AND q.position - o.position BETWEEN 1 AND 24"""),
    "v_forest_row": (["v_split"], """
SELECT building_id, timestamp, part, CAST([meter_reading, air_temperature, hour, dayofweek, is_weekend, hour_sin, hour_cos, lag_1h, lag_24h] AS DOUBLE[]) AS x,
  CAST(CAST('0x' || substr(md5(building_id || '|' || CAST(timestamp AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS p FROM v_split"""),
    "v_forest_sample": (["v_forest_row"], f"""
SELECT tree, x FROM (
  SELECT tree, x, row_number() OVER (PARTITION BY tree ORDER BY u, building_id, timestamp) AS k FROM (
    SELECT CAST(t.tree AS BIGINT) AS tree, r.*, r.p + t.tree * CAST({forest.TURN} AS DOUBLE) - floor(r.p + t.tree * CAST({forest.TURN} AS DOUBLE)) AS u
    FROM v_forest_row r, range(150) t(tree) WHERE r.part = 'train') a) b WHERE k <= 256"""),
    # one level of all trees per step: the rows of a node go on to its children
    "v_forest_grow": (["v_forest_sample"], f"""
  SELECT tree, CAST(1 AS BIGINT) AS place, CAST(0 AS BIGINT) AS depth, x, count(*) OVER (PARTITION BY tree) AS drawn FROM v_forest_sample
  UNION ALL
  SELECT tree, place * 2 + CASE WHEN x[feature + 1] <= threshold THEN 0 ELSE 1 END, depth + 1, x, drawn FROM ({_forest_nodes("SELECT * FROM v_forest_grow", "x, ")}) s WHERE feature IS NOT NULL"""),
    "v_forest_node": (["v_forest_grow"], f"""
SELECT tree, place, coalesce(feature, 0) AS feature, coalesce(threshold, 0.0) AS threshold, feature IS NULL AS leaf,
  CASE WHEN feature IS NULL THEN depth + {_average_path("n")} ELSE 0.0 END AS path
FROM (SELECT DISTINCT tree, place, depth, n, feature, threshold FROM ({_forest_nodes("SELECT * FROM v_forest_grow")}) s) d"""),
    "v_forest_walk": (["v_forest_row", "v_forest_node"], """
  SELECT building_id, timestamp, x, CAST(tree AS BIGINT) AS tree, CAST(1 AS BIGINT) AS place FROM v_forest_row, range(150) t(tree)
  UNION ALL
  SELECT w.building_id, w.timestamp, w.x, w.tree, w.place * 2 + CASE WHEN w.x[n.feature + 1] <= n.threshold THEN 0 ELSE 1 END
  FROM v_forest_walk w JOIN v_forest_node n ON n.tree = w.tree AND n.place = w.place WHERE NOT n.leaf"""),
    "v_forest_raw": (["v_forest_walk", "v_forest_node", "v_forest_sample"], f"""
SELECT building_id, timestamp, power(2.0, -(sum(path) / 150) / (SELECT {_average_path("count(*)")} FROM v_forest_sample WHERE tree = 0)) AS score
FROM v_forest_walk w JOIN v_forest_node n ON n.tree = w.tree AND n.place = w.place WHERE n.leaf GROUP BY 1, 2"""),
    "v_forest_score": (["v_forest_raw", "v_split"], f"""
SELECT r.building_id, r.timestamp, o.t - score AS decision, CAST(CASE WHEN o.t - score < 0 THEN -1 ELSE 1 END AS BIGINT) AS label,
  greatest(0.0, least(1.0, (score - o.t - (o.lo - o.t)) / ((o.hi - o.t) - (o.lo - o.t)))) AS anomaly_score
FROM v_forest_raw r, (SELECT min(g) / 1000000.0 AS lo, max(g) / 1000000.0 AS hi, quantile_cont(g, 0.97) / 1000000.0 AS t FROM (
  SELECT CAST({r("score * 1000000", 0)} AS DOUBLE) AS g FROM v_forest_raw f JOIN v_split s ON s.building_id = f.building_id AND s.timestamp = f.timestamp WHERE s.part = 'train') q) o"""),
    # a reading is judged as the forest judges its building's hour; hours without features are normal
    "v_live_item": (["v_meter_reading", "v_forest_score"], f"""
SELECT m.*, coalesce(f.label, 1) AS forest_label, coalesce({r("-f.decision", 6)}, -0.1) AS anomaly_score, coalesce({r("f.anomaly_score", 4)}, 0.0) AS forest_score
FROM v_meter_reading m LEFT JOIN v_forest_score f ON f.building_id = m.building_id AND f.timestamp = date_trunc('hour', m.timestamp)"""),
    "v_model_load": (["v_split", "v_arx"], f"""
SELECT s.building_id, s.timestamp, {r("w.w0 + w.w1 * lag_1h + w.w2 * lag_24h + w.w3 * air_temperature", 4)} AS model_load FROM v_split s JOIN v_arx w ON w.building_id = s.building_id"""),
    "v_arx": (["v_split"], _arx_weights()),
    # the recursive forecast as a recursive query: one hour ahead of every origin per step
    "v_arx_walk": (["v_test", "v_arx"], """
  SELECT q.building_id, o.timestamp AS origin_timestamp, CAST(1 AS BIGINT) AS h, q.position, q.timestamp AS target_timestamp, q.meter_reading AS actual,
    w.w0 + w.w1 * q.lag_1h + w.w2 * q.lag_24h + w.w3 * q.air_temperature AS prediction
  FROM v_test o JOIN v_test q ON q.building_id = o.building_id AND q.position = o.position + 1 JOIN v_arx w ON w.building_id = o.building_id
  UNION ALL
  SELECT q.building_id, p.origin_timestamp, p.h + 1, q.position, q.timestamp, q.meter_reading, w.w0 + w.w1 * p.prediction + w.w2 * q.lag_24h + w.w3 * q.air_temperature
  FROM v_arx_walk p JOIN v_test q ON q.building_id = p.building_id AND q.position = p.position + 1 JOIN v_arx w ON w.building_id = p.building_id WHERE p.h < 24"""),
    "v_prediction": (["v_pair", "v_arx_walk"], f"""
SELECT model, building_id, origin_timestamp, horizon_h, target_timestamp, actual, prediction
FROM (UNPIVOT v_pair ON lag24, lag1, hour_profile INTO NAME model VALUE prediction) u
UNION ALL SELECT 'seasonal_arx', building_id, origin_timestamp, h, target_timestamp, actual, {r("prediction", 2)} FROM v_arx_walk"""),
    "v_by_horizon": (["v_prediction"], f"""
SELECT model, horizon_h, {r("avg(abs(actual - prediction))", 4)} AS mae, {r("sqrt(avg((actual - prediction) * (actual - prediction)))", 4)} AS rmse
FROM v_prediction GROUP BY 1, 2"""),
    "v_result": (["v_prediction"], f"""
SELECT model, count(*) AS rows, {r("avg(abs(actual - prediction))", 4)} AS mae, {r("sqrt(avg((actual - prediction) * (actual - prediction)))", 4)} AS rmse,
  {r("avg(abs((actual - prediction) / actual)) * 100", 4)} AS mape, {r("1.0 - avg((actual - prediction) * (actual - prediction)) / var_pop(actual)", 6)} AS r2
FROM v_prediction WHERE horizon_h = 1 GROUP BY 1"""),
    "v_forecast": (["v_clean", "v_span"], f"""
SELECT building_id, timestamp + INTERVAL 24 HOUR AS timestamp, meter_reading AS predicted_kwh, meter_reading * 0.8 AS lower_bound_95,
  meter_reading * 1.2 AS upper_bound_95, air_temperature AS outdoor_temperature_c
FROM v_clean WHERE timestamp > {LAST_HOUR} - INTERVAL 24 HOUR"""),
    "v_scored": (["v_split", "v_profile"], """
SELECT f.building_id, f.timestamp, f.meter_reading AS meter_reading_kwh, f.air_temperature AS outdoor_temperature_c, p.profile_kwh AS predicted_kwh,
  f.meter_reading - p.profile_kwh AS residual, least(1.0, f.meter_reading / 1000.0) AS anomaly_score, f.meter_reading > p.profile_kwh * 1.15 AS is_anomaly,
  CASE WHEN NOT f.meter_reading > p.profile_kwh * 1.15 THEN 'Normal' WHEN f.meter_reading > p.profile_kwh * 1.3 THEN 'Critical' ELSE 'Medium' END AS severity
FROM v_split f JOIN v_profile p ON p.building_id = f.building_id AND p.dayofweek = f.dayofweek AND p.hour = f.hour"""),
    "v_rate": (["v_meter_reading"], """
SELECT id, building_id, zone_id, meter_id, timestamp, meter_reading_kwh, outdoor_temperature_c,
  coalesce(list(rate ORDER BY timestamp DESC, id DESC) FILTER (WHERE rate IS NOT NULL) OVER (PARTITION BY meter_id ORDER BY timestamp, id ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING), []) AS rates,
  CASE WHEN dt > 0 AND dt <= 3600 THEN dt ELSE 3600.0 END AS interval_seconds
FROM (SELECT *, CASE WHEN dt BETWEEN 1 AND 7200 THEN meter_reading_kwh * (3600.0 / least(dt, 3600.0)) END AS rate
      FROM (SELECT *, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY meter_id ORDER BY timestamp, id)) / 1000000.0 AS dt FROM v_meter_reading) a) b"""),
}

DERIVED["v_flagged"] = (["v_meter_reading"], """
SELECT id, building_id, CASE WHEN id % 50 <> 0 THEN building_id END AS meter_id, timestamp, meter_reading_kwh AS actual_kwh, id % 100 / 100.0 AS anomaly_score,
  CASE WHEN meter_reading_kwh >= 60 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity,
  row_number() OVER (PARTITION BY CASE WHEN id % 50 <> 0 THEN building_id END ORDER BY timestamp, id) AS n
FROM v_meter_reading WHERE meter_reading_kwh >= 15""")
# the cooldown fold as a recursive query: one step per event of a meter, in time order
DERIVED["v_cooldown"] = (["v_flagged", "v_open_incident"], """
  SELECT meter_id, CAST(0 AS BIGINT) AS n, id AS open_id, building_id, timestamp AS ts, opened_at, actual_reading AS kwh, anomaly_score AS score, severity, CAST(0 AS BIGINT) AS updates
  FROM v_open_incident
  UNION ALL
  SELECT meter_id, n2, CASE WHEN inside THEN open_id ELSE 'ANOM-LIVE-' || CAST(id2 AS STRING) END, building_id, CASE WHEN inside AND NOT up THEN ts ELSE ts2 END, CASE WHEN inside THEN opened_at ELSE ts2 END,
    CASE WHEN inside AND NOT up THEN kwh ELSE kwh2 END, CASE WHEN NOT inside THEN score2 WHEN up THEN greatest(score, score2) ELSE score END,
    CASE WHEN inside AND NOT up THEN severity ELSE severity2 END, CASE WHEN inside THEN updates + CASE WHEN up THEN 1 ELSE 0 END ELSE 0 END
  FROM (SELECT f.*, e.id AS id2, e.n AS n2, e.timestamp AS ts2, e.actual_kwh AS kwh2, e.anomaly_score AS score2, e.severity AS severity2,
          e.timestamp - f.ts <= INTERVAL 10 MINUTE AS inside, e.actual_kwh > f.kwh AS up
        FROM v_cooldown f JOIN v_flagged e ON e.meter_id = f.meter_id AND e.n = f.n + 1) s""")


def _last(pattern: str) -> str:
    """Place of the last ``pattern`` in ``w``, -1 when absent."""
    return f"(CASE WHEN contains(w, {pattern}) THEN length(w) - instr(reverse(w), reverse({pattern})) - length({pattern}) + 1 ELSE -1 END)"


DERIVED["v_body"] = (["v_kb_document"], r"""
SELECT doc_id, title, source, regexp_replace(body, '^\s+|\s+$', '', 'g') AS body FROM (
  SELECT doc_id, regexp_extract(content, '(?s)^---\s*\n(.*?)\n---\s*\n(.*)$', 2) AS body, regexp_extract(content, 'title: (.*)', 1) AS title, regexp_extract(content, 'source: (.*)', 1) AS source FROM v_kb_document) q""")
# the chunker as a recursive query: one passage of each document per step
DERIVED["v_passage"] = (["v_body"], f"""
  SELECT doc_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS next, CAST(NULL AS STRING) AS piece, false AS done FROM v_body
  UNION ALL
  SELECT doc_id, next, CASE WHEN fin THEN next ELSE greatest(next + 1, stop - 200) END,
    CASE WHEN fin THEN substr(body, next + 1) ELSE substr(body, next + 1, stop - next) END, fin
  FROM (SELECT *, next + CASE WHEN pp >= 600 THEN pp WHEN pl >= 600 THEN pl WHEN ps >= 600 THEN ps ELSE 1200 END AS stop FROM (
    SELECT *, {_last("concat(chr(10), chr(10))")} AS pp, {_last("chr(10)")} AS pl, CASE WHEN contains(w, '. ') THEN {_last("'. '")} + 1 ELSE -1 END AS ps FROM (
      SELECT p.doc_id, p.next, b.body, substr(b.body, p.next + 1, 1200) AS w, p.next + 1200 >= length(b.body) AS fin
      FROM v_passage p JOIN v_body b ON b.doc_id = p.doc_id WHERE NOT p.done) x) y) z""")
DERIVED["v_chunk"] = (["v_passage", "v_body"], r"""
SELECT concat(c.doc_id, '_chunk_', c.chunk_index) AS id, c.doc_id, b.title, b.source, c.chunk_index, count(*) OVER (PARTITION BY c.doc_id) AS total_chunks, c.piece AS text
FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_index, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS piece FROM v_passage WHERE piece <> '') c
JOIN v_body b ON b.doc_id = c.doc_id""")

ALL = {**SHARED, **DERIVED}
RECURSIVE = {"v_cooldown", "v_passage", "v_arx_walk", "v_forest_grow", "v_forest_walk"}


def cte(*names: str, heads: tuple[str, ...] = ()) -> str:
    """``WITH`` clause of the views and all they read, in order, after ``heads``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ALL and name not in ordered:
            for needed in ALL[name][0]:
                visit(needed)
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered and not heads:
        return ""
    head = "WITH RECURSIVE " if RECURSIVE & set(ordered) else "WITH "
    return head + ",\n".join([*heads, *[f"{n} AS ({ALL[n][1]}\n)" for n in ordered]]) + "\n"


def base_tables(*names: str) -> set[str]:
    """Given tables that the views read."""
    found: set[str] = set()
    for name in names:
        found |= base_tables(*SHARED[name][0]) if name in SHARED else {name}
    return found


def over(spark: SparkSession, text: str, frames: dict[str, DataFrame], *views: str) -> DataFrame:
    """Runs ``text`` over shared views, with the given frames as their tables.

    The frames get names of their own, so that no view of the caller's
    session is replaced.
    """
    heads = []
    for name, frame in frames.items():
        unique = f"wattloom_{name}_{uuid.uuid4().hex[:12]}"
        frame.createOrReplaceTempView(unique)
        heads.append(f"{name} AS (SELECT * FROM {unique})")
    result = spark.sql(cte(*views, heads=tuple(heads)) + text)
    for head in heads:
        spark.catalog.dropTempView(head.split()[-1].rstrip(")"))
    return result


class Tables:
    """The given tables of one folder, and the frames queries share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._base: dict[str, DataFrame] = {}
        self._kept: DataFrame | None = None
        self._span: tuple[str, str, str] | None = None

    def span(self) -> tuple[str, str, str]:
        """First and last hour of the days that readings span, and the hour after them; without readings a day long past."""
        if self._span is None:
            found = self("v_span").select(F.date_format("first_hour", S_FORMAT), F.date_format("last_hour", S_FORMAT), F.date_format(F.expr("last_hour + INTERVAL 1 HOUR"), S_FORMAT)).first()
            self._span = tuple(found) if found[0] else ("1970-01-01 00:00:00", "1970-01-01 23:00:00", "1970-01-02 00:00:00")
        return self._span

    def base(self, name: str) -> DataFrame:
        if name not in self._base:
            self._base[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._base[name]

    def __call__(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}", name)

    def sql(self, text: str, *names: str) -> DataFrame:
        """Runs ``text`` over the shared views it names."""
        return over(self.spark, text, {n: self.base(n) for n in sorted(base_tables(*names))}, *names)

    def series(self) -> DataFrame:
        start, _, now = self.span()
        return aggregates.hourly_building_series(self("v_meter_reading"), start, now)

    def hourly(self) -> DataFrame:
        buildings = self("v_telemetry").select("building_id").distinct()
        return aggregates.on_full_grid(self.series(), buildings, *self.span()[:2])

    def clean(self) -> DataFrame:
        return cleaning.interpolate_linear(self.hourly(), ["meter_reading", "air_temperature"])

    def features(self) -> DataFrame:
        return features.engineer(self.clean())

    def split(self) -> DataFrame:
        return features.chronological_split(self.features())

    def kept_split(self) -> DataFrame:
        """The split features as a written table, for queries that use them more than once.

        The readings are scanned and windowed a single time; what follows
        reads one row per building and hour.
        """
        if self._kept is None:
            self._kept = cut_lineage(self.split(), "features")
        return self._kept

    def profile(self) -> DataFrame:
        return aggregates.hour_profile(self.kept_split().filter(F.col("part") == "train"))

    def with_profile(self) -> DataFrame:
        """Feature rows with the value of the hour-profile model."""
        return self.kept_split().join(self.profile(), ["building_id", "dayofweek", "hour"])

    def scored(self) -> DataFrame:
        """A scored frame from rules alone: the profile predicts, 15 % above it is an anomaly."""
        actual, predicted = F.col("meter_reading"), F.col("profile_kwh")
        flag = actual > predicted * 1.15
        return self.with_profile().select(
            "building_id", "timestamp", actual.alias("meter_reading_kwh"), F.col("air_temperature").alias("outdoor_temperature_c"),
            predicted.alias("predicted_kwh"), (actual - predicted).alias("residual"),
            F.least(F.lit(1.0), actual / 1000.0).alias("anomaly_score"), flag.alias("is_anomaly"),
        )

    def forecast(self) -> DataFrame:
        """Seasonal-naive forecast of the 24 hours after the series, with a 20 % band."""
        last = F.lit(self.span()[1]).cast("timestamp_ntz") - F.expr("interval 24 hours")
        kwh = F.col("meter_reading")
        return self.clean().filter(F.col("timestamp") > last).select(
            "building_id", (F.col("timestamp") + F.expr("interval 24 hours")).alias("timestamp"), kwh.alias("predicted_kwh"),
            (kwh * 0.8).alias("lower_bound_95"), (kwh * 1.2).alias("upper_bound_95"),
            F.col("air_temperature").alias("outdoor_temperature_c"),
        )


def rule_models() -> dict[str, Column]:
    """Three forecasters that need no training beyond the hour profile."""
    return {"lag24": F.col("lag_24h"), "lag1": F.col("origin_reading"), "hour_profile": F.col("profile_kwh")}
