"""Invariants of trained models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.functions import settings as S
from wattloom.operators import boosting, evaluation, forecast
from wattloom.plans.q_models import KEYS, Trained


@pytest.fixture(scope="module")
def made(spark, folder):
    return Trained(spark, folder)


COLUMNS = ["x0", "x1", "x2"]


def noisy_steps(n=2000, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3)).round(3)
    x[:, 2] = rng.integers(0, 5, n)
    return x, (np.where(x[:, 1] > 0.5, 10.0, 2.0) + x[:, 2] + rng.normal(0, 0.5, n)).round(3)


def as_table(spark, x, y, part=None):
    rows = [(k, *map(float, r), float(v), 0 if part is None else int(part[k])) for k, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, y double, part int")


def boost(spark, x, y, *specs, part=None):
    return boosting.fit(as_table(spark, x, y, part), COLUMNS, "y", ["id"], list(specs), F.col("part"))


def test_boosting_fits_steps_and_their_quantiles(spark):
    x, y = noisy_steps()
    truth = np.where(x[:, 1] > 0.5, 10.0, 2.0) + x[:, 2]
    point, low, high = (f.model for f in boost(spark, x, y, *[boosting.Spec(q) for q in (None, 0.05, 0.95)]))
    assert len(point.weights) == 350 and np.abs(point.predict(x) - truth).mean() < 0.3
    assert 0.8 < ((low.predict(x) <= y) & (y <= high.predict(x))).mean() <= 1 and (low.predict(x) <= high.predict(x)).mean() > 0.95


def test_boosting_without_rows_or_with_one_value(spark):
    none = as_table(spark, np.zeros((1, 3)), np.zeros(1)).where("false")
    fitted = boosting.fit(none, COLUMNS, "y", ["id"], [boosting.Spec(), boosting.Spec(0.5)])
    assert [f.model.predict(np.zeros((3, 3))).tolist() for f in fitted] == [[0, 0, 0]] * 2
    for f in boost(spark, np.ones((5, 3)), np.full(5, 7.0), boosting.Spec(rounds=5), boosting.Spec(0.5, rounds=5)):
        assert np.allclose(f.model.predict(np.zeros((2, 3))), 7)


def row_booster(x, y, edges, spec, buckets):
    """The same model from rows instead of cells, written plainly; every question is answered from all rows."""
    bins = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]
    rng = np.random.default_rng(spec.seed)
    least = lambda r: np.sort(r)[max(1, int(np.ceil(spec.quantile * len(r) - 1e-9))) - 1]
    now = np.full(len(y), y.mean() if spec.quantile is None else least(y))
    for _ in range(spec.rounds):
        skip = rng.choice(boosting.BUCKETS, round((1 - spec.subsample) * boosting.BUCKETS), replace=False)
        picked = sorted(rng.choice(x.shape[1], max(1, round(spec.columns * x.shape[1])), replace=False).tolist())
        use = ~np.isin(buckets, skip)
        residual = y - now
        g = residual if spec.quantile is None else np.where(residual >= 0, spec.quantile, spec.quantile - 1)
        node = np.zeros(len(y), int)
        for level in range(spec.depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                mine, best, found = use & (node == k), 1e-12, None
                for f in picked:
                    for cut in range(len(edges[f])):
                        left, right = mine & (bins[f] <= cut), mine & (bins[f] > cut)
                        if left.any() and right.any():
                            gain = g[left].sum() ** 2 / left.sum() + g[right].sum() ** 2 / right.sum() - g[mine].sum() ** 2 / mine.sum()
                            if gain > best + 1e-9:
                                best, found = gain, (f, cut)
                if found:
                    node = np.where(node == k, 2 * k + 1 + (bins[found[0]] > found[1]), node)
        for k in np.unique(node):
            r = residual[use & (node == k)]
            if len(r):
                now = now + np.where(node == k, spec.rate * (r.mean() if spec.quantile is None else least(r)), 0)
    return now


@pytest.mark.parametrize("quantile", [None, 0.9])
def test_boosting_on_cells_equals_boosting_on_rows(spark, quantile):
    x, y = noisy_steps(120, 3)
    x[:, 0] = (x[:, 0] * 6).round() / 6
    table = as_table(spark, x, y)
    edges = boosting.bin_edges(table, COLUMNS)
    buckets = np.array([r[0] for r in table.select(F.pmod(F.xxhash64("id"), F.lit(boosting.BUCKETS))).collect()])
    spec = boosting.Spec(quantile, rounds=6, depth=2, rate=0.3)
    want = row_booster(x, y, edges, spec, buckets)
    assert np.allclose(boost(spark, x, y, spec)[0].model.predict(x), want, atol=1e-6)


def test_many_blocks_give_the_model_of_one(spark, monkeypatch):
    x, y = noisy_steps(700, 5)
    part = np.arange(700) % 3 // 2
    specs = [boosting.Spec(rounds=7, depth=3, rate=0.3, check=1), boosting.Spec(0.9, rounds=5, depth=2, rate=0.3, check=1), boosting.Spec(rounds=2, learn=1, check=0)]
    one = boost(spark, x, y, *specs, part=part)
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 100)
    monkeypatch.setattr(boosting, "REWRITE", 3)
    many = boost(spark, x, y, *specs, part=part)
    for a, b in zip(one, many):
        assert np.allclose(a.model.predict(x), b.model.predict(x), atol=1e-6) and abs(a.rmse - b.rmse) < 1e-6
    seen = one[0].model.predict(x[part == 1])
    assert abs(one[0].rmse - np.sqrt(np.mean((seen - y[part == 1]) ** 2))) < 1e-9


def test_a_rare_building_is_learned(spark):
    rng = np.random.default_rng(2)
    x = rng.random((20_000, 3)).round(2)
    rare = np.arange(20_000) % 1000 == 0  # a thousandth of the rows has its own range of the first feature
    x[rare, 0] = 5.0
    y = np.where(rare, 500.0, 10.0) + rng.normal(0, 1, 20_000).round(2)
    point, low, high = (f.model for f in boost(spark, x, y, *[boosting.Spec(q, rounds=120) for q in (None, 0.025, 0.975)]))
    assert abs(point.predict(x[rare]) - 500).max() < 30
    # pinball gradients of so few rows don't decide the first splits, but no row is left out
    inside = (low.predict(x) <= y) & (y <= high.predict(x))
    assert inside[~rare].mean() > 0.9 and high.predict(x[rare]).mean() > high.predict(x[~rare]).mean()


def test_search_prunes_what_is_worse_than_the_median(made):
    found = forecast.grid_search(made.train, [{"rounds": 40, "rate": r, "depth": 3} for r in (0.1, 0.08, 0.001, 0.0005)]).collect()
    assert [r.pruned for r in found] == [False, False, True, True] and [r.folds for r in found] == [3, 3, 1, 1]
    assert sum(r.is_best for r in found) == 1 and min(found, key=lambda r: r.mean_rmse).is_best


def test_quantiles_are_ordered_on_average_and_cover(made):
    scored = forecast.load_predict(made.train, made.load)
    row = evaluation.pinball_coverage(scored.withColumn("actual", F.col("meter_reading"))).first()
    assert row.coverage_95 > 0.85 and row.mean_width > 0


def test_bounds_enclose_the_forecast(made):
    rows = forecast.recursive_forecast(made.split, made.load).collect()
    assert len(rows) == 4 * 24
    assert all(0 <= r.lower_bound_95 <= r.predicted_kwh <= r.upper_bound_95 for r in rows)
    first = {r.building_id: r.timestamp for r in rows if r.timestamp == min(x.timestamp for x in rows)}
    assert len(first) == 4


def test_first_horizon_is_the_one_step_prediction(made):
    grid = forecast.recursive_grid(made.test, made.load)
    one = forecast.load_predict(made.test, made.load).select("building_id", F.col("timestamp").alias("target_timestamp"), F.col("prediction").alias("p"))
    pairs = grid.filter(F.col("horizon_h") == 1).join(one, ["building_id", "target_timestamp"])
    assert pairs.count() == made.test.count() - 4
    assert pairs.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-9
    assert grid.filter(F.col("horizon_h") == 24).count() == made.test.count() - 4 * 24


def test_scale_follows_the_level(made):
    tripled = made.split.select(
        "building_id", "timestamp", "air_temperature",
        F.when(F.col("building_id") == "b1", F.col("meter_reading") * 3).otherwise(F.col("meter_reading")).alias("meter_reading"),
    )
    scale = {r.building_id: r.scale for r in forecast.live_scale(tripled, made.load).collect()}
    assert scale["b1"] > 1.5 and all(0.05 <= s <= 5.0 for s in scale.values())


def test_scored_frame_is_complete(made):
    scored = forecast.score_frame(made.test, made.load, made.forest)
    assert scored.columns[2:] == [
        "meter_reading_kwh", "outdoor_temperature_c", "predicted_kwh", "residual", "lower_bound_95", "upper_bound_95",
        "anomaly_score", "is_anomaly", "severity",
    ]
    odd = scored.filter((F.col("severity") == "Normal") == F.col("is_anomaly")).count()
    assert odd == 0 and scored.count() == made.test.count()


def test_arx_recovers_weights(spark):
    import datetime as dt
    import random

    rng, rows = random.Random(1), []
    for i in range(400):
        a, b, t = rng.random() * 50, rng.random() * 50, rng.random() * 30
        rows.append(("b", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 5 + 0.5 * a + 0.3 * b - 1.5 * t, a, b, t))
    df = spark.createDataFrame(rows, "building_id string, timestamp timestamp_ntz, meter_reading double, lag_1h double, lag_24h double, air_temperature double")
    weights = forecast.arx_fit(df).first().weights
    assert [round(w, 6) for w in weights] == [5.0, 0.5, 0.3, -1.5]
    gap = forecast.arx_predict(df, forecast.arx_fit(df)).agg(F.max(F.abs(F.col("prediction") - F.col("meter_reading")))).first()[0]
    assert gap < 1e-6


def test_features_are_the_documented_ones():
    assert len(S.LOAD_FEATURES) == 8 and len(S.DETECTOR_FEATURES) == 9
