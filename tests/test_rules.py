"""Hand-computed cases of single rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattloom.functions import rules, text_rules
from wattloom.operators import aggregates, cleaning, drift, evaluation, features, incidents, relations, scenarios, text
from wattloom.sources import files


def ts(text):
    return dt.datetime.fromisoformat(text)


PLAN = "scenario string, building_id string, setpoint_delta_c double, off_hours double, hvac_share double"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_monthly_summary_against_month_before(spark):
    rows = [
        ("b", ts("2026-10-01 00:00:00"), 100.0), ("b", ts("2026-10-01 10:00:00"), 120.0),
        ("b", ts("2026-10-02 00:00:00"), 80.0), ("b", ts("2026-09-15 00:00:00"), 250.0),
    ]
    out = aggregates.monthly_summary(frame(spark, rows, "building_id string, timestamp timestamp_ntz, meter_reading double"))
    october = {r.month: r for r in out.collect()}["2026-10"]
    assert (october.total_consumption_kwh, october.average_daily_kwh, october.peak_demand_kw) == (300.0, 150.0, 120.0)
    assert october.change_vs_previous_month_pct == 20.0


def test_monthly_summary_fills_empty_months(spark):
    rows = [("b", ts("2026-07-01 00:00:00"), 10.0), ("b", ts("2026-09-01 00:00:00"), 20.0)]
    out = aggregates.monthly_summary(frame(spark, rows, "building_id string, timestamp timestamp_ntz, meter_reading double"))
    by = {r.month: r for r in out.collect()}
    assert by["2026-08"].total_consumption_kwh == 0.0 and by["2026-08"].change_vs_previous_month_pct == -100.0
    assert by["2026-09"].change_vs_previous_month_pct is None


def test_hourly_series_prefers_zones_and_skips_the_running_hour(spark):
    at = lambda h, m=0: ts(f"2024-01-01 {h:02d}:{m:02d}:00")
    rows = [
        ("b", "z1", at(1), 25.0, 30.0), ("b", "z2", at(1, 30), 15.0, None), ("b", None, at(1, 40), 180.0, 28.0),
        ("b", None, at(2), 190.0, None), ("b", None, at(3), 1.0, None),
    ]
    schema = "building_id string, zone_id string, timestamp timestamp_ntz, meter_reading_kwh double, outdoor_temperature_c double"
    out = aggregates.hourly_building_series(frame(spark, rows, schema), "2024-01-01 00:00:00", "2024-01-01 03:20:00")
    got = {r.timestamp.hour: (r.meter_reading_kwh, r.outdoor_temperature_c) for r in out.collect()}
    assert got == {1: (40.0, 29.0), 2: (190.0, 26.0)}


def test_savings_of_one_degree(spark):
    rows = [("b", ts(f"2024-01-01 {h:02d}:00:00"), 100.0) for h in range(24)]
    forecast = frame(spark, rows, "building_id string, timestamp timestamp_ntz, predicted_kwh double")
    hourly = scenarios.scenario_savings_hourly(forecast, frame(spark, [("one", "b", 1.0, 0.0, 0.5), ("off", "b", 0.0, 3.0, 0.5), ("bad", "b", 9.0, 0.0, 0.5), ("other", "c", 1.0, 0.0, 0.5)], PLAN))
    total = {r.scenario: r for r in scenarios.scenario_savings_total(hourly).collect()}
    assert (total["one"].baseline_kwh, total["one"].low_kwh, total["one"].high_kwh) == (2400.0, 33.0, 44.0)
    assert total["one"].low_vnd == 33.0 * 3100 and total["one"].note is None
    assert total["off"].low_kwh == total["off"].high_kwh == 150.0


def test_savings_without_cooling_hours_carry_a_note(spark):
    forecast = frame(spark, [("b", ts("2024-01-01 18:00:00"), 50.0)], "building_id string, timestamp timestamp_ntz, predicted_kwh double")
    row = scenarios.scenario_savings_total(scenarios.scenario_savings_hourly(forecast, frame(spark, [("one", "b", 1.0, 0.0, 0.5)], PLAN))).first()
    assert row.low_kwh == 0.0 and row.note


def test_live_scoring_judges_by_the_meter(spark):
    schema = (
        "id long, building_id string, zone_id string, meter_id string, timestamp timestamp_ntz, meter_reading_kwh double, "
        "interval_seconds double, outdoor_temperature_c double, recent_meter_hourly_kwhs array<double>, hours_known int, "
        "model_load double, forest_flag boolean, forest_score double"
    )
    at = ts("2024-01-01 10:00:00")
    rows = [
        (1, "b", "z1", "m1", at, 1.5, 300.0, 30.0, [18.0, 18.0, 18.0], 24, 300.0, False, 0.2),
        (2, "b", "z1", "m1", at, 3.75, 300.0, None, [18.0, 18.0, 18.0], 24, 300.0, False, 0.2),
        (3, "b", None, "m2", at, 260.0, 3600.0, None, [], 0, None, False, 0.9),
    ]
    profile = frame(spark, [], "building_id string, dayofweek int, hour int, profile_kwh double")
    out = {r.id: r for r in incidents.live_scoring(frame(spark, rows, schema), profile).collect()}
    assert set(out) == {2}
    hit = out[2]
    assert (hit.severity, hit.actual_kwh, hit.predicted_kwh, hit.anomaly_score) == ("CRITICAL", 45.0, 18.0, 0.72)
    assert hit.outdoor_temp_c == 26.0 and "2.50x" in hit.description


def test_severity_rule(spark):
    rows = [(0.0, 1.0, 1.0), (-0.5, 30.0, 10.0), (-0.02, 1.0, 1.0), (-0.5, 18.0, 10.0), (-0.5, 9.0, None), (-0.5, 9.0, 0.0)]
    df = frame(spark, rows, "s double, a double, l double")
    got = [r[0] for r in df.select(rules.severity(F.col("s"), F.col("a"), F.col("l"))).collect()]
    assert got == ["HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]


def test_interpolation_by_position(spark):
    values = [None, 1.0, None, None, 4.0, None]
    rows = [("b", ts(f"2024-01-01 {h:02d}:00:00"), v) for h, v in zip([0, 1, 2, 9, 10, 11], values)]
    out = cleaning.interpolate_linear(frame(spark, rows, "building_id string, timestamp timestamp_ntz, v double"), ["v"])
    assert [r.v for r in out.orderBy("timestamp").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_strict_json_isolates_bad_rows(spark):
    rows = [('{"k": 1.5}',), ('{"k": NaN}',), ('{"k": 1',), ("[1]",), (None,), ('{"k": null}',)]
    out = files.strict_json_rows(frame(spark, rows, "p string"), "p", "k DOUBLE")
    assert [(r.k, r.error) for r in out.collect()] == [
        (1.5, None), (None, "non_finite"), (None, "invalid_json"), (None, "wrong_type"), (None, None), (None, None)
    ]


def test_status_conflicts(spark):
    current = frame(spark, [("a", "OPEN"), ("b", "OPEN")], "id string, status string").withColumn(
        "status_history", F.from_json(F.lit("[]"), incidents.HISTORY_TYPE)
    )
    asked = [(1, "a", "RESOLVED", "OPEN"), (2, "a", "IGNORED", "OPEN"), (3, "b", "DONE", "OPEN"), (4, "c", "OPEN", "OPEN"), (5, "b", "OPEN", "RESOLVED")]
    requests = frame(spark, asked, "request_id int, id string, status string, seen_status string").withColumns(
        {"seen_history": F.lit(0), "note": F.lit("x")}
    )
    out = {r.request_id: r for r in incidents.status_transition(requests, current, "now").collect()}
    assert [out[i].outcome for i in range(1, 6)] == ["updated", "conflict", "invalid_status", "not_found", "conflict"]
    assert out[1].status_history[0].previous_status == "OPEN" and out[1].current_status == "RESOLVED"


def test_dedup_keeps_stored_then_first(spark):
    at = ts("2024-01-01 00:00:00")
    schema = "id long, building_id string, zone_id string, timestamp timestamp_ntz, arrival long"
    incoming = frame(spark, [(1, "b", "z1", at, 1), (2, "b", "z2", at, 2), (3, "b", "z2", at, 3), (4, "b", None, at, 4), (5, "b", None, at, 5)], schema)
    stored = frame(spark, [(9, "b", "z1", at, 0), (8, "b", None, at, 0)], schema)
    assert [r.id for r in relations.ingest_dedup(incoming, stored, "arrival").collect()] == [2]
    assert sorted(r.id for r in relations.keep_lowest_id(incoming).collect()) == [1, 2, 4]


def test_holdout_mape_policy(spark):
    rows = [("ok", 10.0, 9.0), ("ok", 0.0, 5.0), ("zero", 0.0, 1.0), ("bad", 1.0, float("nan"))]
    out = {r.k: r for r in evaluation.holdout_mape(frame(spark, rows, "k string, actual double, prediction double"), "k").collect()}
    assert out["ok"].mape_percent == 10.0 and out["ok"].rows_used == 1 and out["ok"].error is None
    assert out["zero"].error == "no non-zero target rows" and out["bad"].error == "non-finite values"


def test_recommendation_prefers_cost_in_the_near_tie(spark):
    by_horizon = frame(spark, [("slow", 1, 10.0), ("fast", 1, 10.05), ("poor", 1, 20.0)], "model string, horizon_h int, mae double")
    cost = frame(spark, [("slow", 5.0, 10), ("fast", 1.0, 99), ("poor", 0.1, 1)], "model string, latency_ms double, size_bytes long")
    out = {r.model: r for r in evaluation.model_recommendation(by_horizon, cost).collect()}
    assert [m for m in out if out[m].recommended] == ["fast"] and out["slow"].rank == 1 and not out["poor"].is_contender


def series(spark, name, values):
    start = ts("2024-01-01 00:00:00")
    rows = [("b", start + dt.timedelta(hours=i), float(v)) for i, v in enumerate(values)]
    return frame(spark, rows, f"building_id string, timestamp timestamp_ntz, {name} double")


def test_drift_of_equal_constant_and_moved_samples(spark):
    same = series(spark, "v", range(200))
    moved = series(spark, "v", range(300, 500))
    constant = series(spark, "v", [5] * 200)
    check = lambda a, b: drift.samples(a, b, ["v"])
    assert drift.psi(check(same, same)).first().psi == 0.0
    assert drift.psi(check(constant, moved)).first().psi == 0.0
    assert drift.psi(check(same, moved)).first().psi > 0.2
    ks = drift.ks_two_sample(check(same, moved)).first()
    assert ks.ks_statistic == 1.0 and ks.p_value == 0.0 and not ks.insufficient_data
    nothing = drift.ks_two_sample(check(same, series(spark, "v", []))).first()
    assert nothing.insufficient_data and nothing.p_value == 1.0


def test_psi_falls_back_to_equal_widths(spark):
    tied = series(spark, "v", [0] * 150 + list(range(1, 51)))
    moved = series(spark, "v", [0] * 50 + list(range(1, 151)))
    assert drift.psi(drift.samples(tied, moved, ["v"])).first().psi > 0.2


def test_drift_check_names_the_signals(spark):
    calm, wild = series(spark, "v", range(200)), series(spark, "v", range(300, 500))
    rolling = frame(spark, [("b", 22.0)], "building_id string, mape_percent double")
    row = drift.drift_check(calm, wild, rolling, ["v"]).first()
    assert row.triggered_signals == ["v", "rolling_mape"] and row.drift_detected
    only = drift.drift_check(calm, calm, rolling, ["v"])
    nobody = frame(spark, [], "building_id string")
    assert drift.retrain_trigger(only, nobody).first().retrain_trigger == "mape"


def test_folds_stay_inside_training(spark):
    train = series(spark, "meter_reading", range(41))
    folds = features.expanding_folds(train, 3)
    sizes = {(r.fold, r.role): r.n for r in folds.groupBy("fold", "role").agg(F.count("*").alias("n")).collect()}
    assert sizes == {(1, "train"): 10, (1, "validate"): 10, (2, "train"): 20, (2, "validate"): 10, (3, "train"): 30, (3, "validate"): 11}
    assert features.check_folds(folds, train).count() == 0
    small = features.expanding_folds(series(spark, "meter_reading", range(5)), 3)
    assert {(r.fold, r.role): r.n for r in small.groupBy("fold", "role").agg(F.count("*").alias("n")).collect()} == {(1, "train"): 4, (1, "validate"): 1}


def test_gate_rejects_ties_and_leakage(spark):
    start = ts("2024-01-01 00:00:00")
    rows = [(b, start, 10.0, 9.0, c) for b, c in (("up", 9.5), ("tie", 9.0), ("leak", 9.5))]
    holdout = frame(spark, rows, "building_id string, timestamp timestamp_ntz, actual double, champion double, challenger double")
    before = start - dt.timedelta(hours=1)
    bounds = frame(spark, [("up", before, None), ("tie", before, before), ("leak", before, start)], "building_id string, train_end timestamp_ntz, champion_train_end timestamp_ntz")
    out = {r.building_id: r for r in evaluation.champion_gate(holdout, bounds).collect()}
    assert [out[b].outcome for b in ("up", "tie", "leak")] == ["promoted", "rejected", "failed"]
    assert out["up"].reason is None and "10.000000%" in out["tie"].reason and out["leak"].champion_mape is None


def test_scenario_questions(spark):
    rows = [("Nếu nâng nhiệt độ đặt thêm 1,5 độ thì sao?",), ("nếu tắt chiller sớm hơn 2 giờ",), ("nhiệt độ đặt 2 độ",)]
    args = text_rules.scenario_args(F.col("q"))
    got = [tuple(r) for r in frame(spark, rows, "q string").select(*args.values()).collect()]
    assert got == [(1.5, None), (None, 2), (None, None)]


def test_source_matching(spark):
    rows = [("peak_tariffs.md", "peak_tariffs", ""), ("code_hvac.md", "other", "CODE_HVAC"), ("cold_tariffs.md", "peak_tariffs", ""), ("abc.md", "xyz", "")]
    df = frame(spark, rows, "e string, d string, s string")
    assert [r[0] for r in df.select(text_rules.source_matches(F.col("e"), F.col("d"), F.col("s"))).collect()] == [True, True, True, False]


def test_frontmatter_defaults(spark):
    docs = [(1, "---\ntitle: A\n---\n\n body \n"), (2, "  plain  ")]
    out = {r.doc_id: r for r in text.parse_frontmatter(frame(spark, docs, "doc_id long, content string")).collect()}
    assert (out[1].title, out[1].source, out[1].body) == ("A", "Tài liệu nội bộ", "body")
    assert (out[2].title, out[2].body) == ("2", "plain")


def test_log_with_bad_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"intent": "a", "latency_ms": 10.0, "tools_called": ["x", "y"], "is_grounded": true}\nnot json\n{"intent": "b", "latency_ms": 20.0, "tools_called": ["x"], "is_grounded": false}\n')
    row = aggregates.interaction_stats(aggregates.read_interaction_log(spark, str(path))).first()
    assert (row.total_queries, row.average_latency_ms, row.grounded_ratio) == (2, 15.0, 0.5)
    assert row.tool_usage_counts == {"x": 2, "y": 1} and row.intents_distribution == {"a": 1, "b": 1}


def test_missing_files_are_reported(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.scan_telemetry(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        files.load_forecast_artifacts(spark, str(tmp_path))
    with pytest.raises(KeyError):
        files.scan_site_weather(frame(spark, [(1, 2)], "site_id int, humidity int"), ["site_id"])


def test_standard_names_are_not_overwritten(spark):
    df = frame(spark, [(1.0, 2.0, 3.0)], "load_kwh double, meter_reading double, temp double")
    assert files.standardise_columns(df).columns == ["load_kwh", "meter_reading", "air_temperature"]


def test_roster_names_every_household_once(spark):
    units = spark.createDataFrame([(1, 7), (2, 7)], "unit_id long, building_id long")
    homes = spark.createDataFrame([(10, 1, None, None), (11, 1, None, None)], "household_id long, unit_id long, starts_at timestamp_ntz, ends_at timestamp_ntz")
    members = spark.createDataFrame([(10, m) for m in range(50)], "household_id long, member_id long")
    invited = spark.createDataFrame([], "household_id long, invitation_id long, accepted_at timestamp_ntz, expires_at timestamp_ntz")
    zones = spark.createDataFrame([("x", 7, 1), ("y", 7, None)], "zone_id string, building_id long, unit_id long")
    rows = relations.unit_roster(units, homes, members, invited, zones, "2024-01-01").collect()
    assert sorted((r.unit_id or 0, r.household_id or 0, len(r.members or []), len(r.zones or [])) for r in rows) == [(0, 0, 0, 1), (1, 10, 50, 1), (1, 11, 0, 1), (2, 0, 0, 0)]


def test_errors_with_zero_and_constant_actuals(spark):
    from wattloom.operators import evaluation

    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.0, 0.0), ("b", 5.0, 4.0), ("b", 5.0, 6.0), ("c", 0.0, 1.0)], "k string, actual double, prediction double")
    got = {r.k: r for r in evaluation.forecast_metrics(df, "k").collect()}
    assert (got["a"].mape, got["a"].r2, got["b"].r2, got["b"].mape) == (0.0, 1.0, 0.0, 20.0) and got["c"].mape > 1e15
    late = df.selectExpr("k AS building_id", "timestamp_ntz '2024-01-01 00:00:00' AS timestamp", "actual", "prediction")
    assert evaluation.rolling_mape(late).count() == 3


def test_a_supplied_interval_stays(spark):
    from wattloom.operators import features

    df = spark.sql("SELECT 1 AS id, 'm' AS meter_id, timestamp_ntz '2024-01-01 00:00:00' AS timestamp, 1.0D AS meter_reading_kwh, 900.0D AS interval_seconds UNION ALL SELECT 2, 'm', timestamp_ntz '2024-01-01 00:10:00', 1.0D, NULL")
    assert {r.id: r.interval_seconds for r in features.meter_hourly_rates(df).collect()} == {1: 900.0, 2: 600.0}


def test_json_rows_are_read_to_their_end(spark):
    from wattloom.sources import files

    texts = ['{"k": 1}', '{"k": 1} x', '{"k": 1},{"k": 2}', '{"k": 1, "o": {"p": [NaN]}}', '{"k": 2, "o": "NaN"}', "[1]", None, "", '{"k": -Infinity}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.k, r.error) for r in files.strict_json_rows(df, "t", "k BIGINT").collect()}
    assert got == {
        0: (1, None), 1: (None, "invalid_json"), 2: (None, "invalid_json"), 3: (None, "non_finite"), 4: (2, None),
        5: (None, "wrong_type"), 6: (None, None), 7: (None, "invalid_json"), 8: (None, "non_finite"),
    }
