"""Load models and the forecasts made with them."""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions import rules
from wattloom.functions import settings as S
from wattloom.functions.numeric import half_up, hours_after
from wattloom.operators import boosting, evaluation, features, rows, trees
from wattloom.operators.forest import IsolationForest, isolation_forest_score
from wattloom.session import cut_lineage

HORIZON = 24


@dataclass
class LoadModel:
    """Point model and its 2.5, 50 and 97.5 percent companions as arrays."""

    point: trees.Ensemble
    quantiles: list[trees.Ensemble]


KEYS = ["building_id", "timestamp"]


def gbt_forecaster(
    train: DataFrame, rounds: int = 350, depth: int = 4, rate: float = 0.05, subsample: float = 0.85,
    columns: float = 0.85, seed: int = 42,
) -> trees.Ensemble:
    """Gradient-boosted load model on the eight features, fitted on all rows of all meters."""
    spec = boosting.Spec(None, rounds, depth, rate, subsample, columns, seed=seed)
    return boosting.fit(train, S.LOAD_FEATURES, "meter_reading", KEYS, [spec])[0].model


def gbt_predict(model: trees.Ensemble, df: DataFrame) -> DataFrame:
    """Adds ``prediction`` from broadcast trees; the model's size is set by its parameters."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(shared.value.predict(np.stack(part.to_numpy())) if len(part) else [], dtype=float)

    return df.withColumn("prediction", run(feature_array()))


def quantile_forecaster(
    train: DataFrame, quantiles: list[float] = S.QUANTILES, rounds: int = 350, depth: int = 4, rate: float = 0.05,
    subsample: float = 0.85, columns: float = 0.85, seed: int = 42,
) -> list[trees.Ensemble]:
    """Boosted quantile models under the pinball loss, fitted side by side on all rows."""
    specs = [boosting.Spec(q, rounds, depth, rate, subsample, columns, seed=seed) for q in quantiles]
    return [f.model for f in boosting.fit(train, S.LOAD_FEATURES, "meter_reading", KEYS, specs)]


def load_model(train: DataFrame, quantiles: list[float] = S.QUANTILES, rounds: int = 350, seed: int = 42) -> LoadModel:
    """The point model and its quantile companions from one reduction of the rows."""
    specs = [boosting.Spec(q, rounds, seed=seed) for q in (None, *quantiles)]
    point, *rest = [f.model for f in boosting.fit(train, S.LOAD_FEATURES, "meter_reading", KEYS, specs)]
    return LoadModel(point, rest)


def feature_array() -> Column:
    return F.array(*[F.col(c).cast("double") for c in S.LOAD_FEATURES])


def load_predict(df: DataFrame, model: LoadModel) -> DataFrame:
    """Adds ``prediction``, ``q_low``, ``q_mid`` and ``q_high`` from broadcast trees."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("prediction double, q_low double, q_mid double, q_high double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in parts:
            x = np.stack(part.to_numpy()) if len(part) else np.zeros((0, len(S.LOAD_FEATURES)))
            names = ["q_low", "q_mid", "q_high"]
            yield pd.DataFrame({"prediction": m.point.predict(x), **{n: q.predict(x) for n, q in zip(names, m.quantiles)}})

    return df.withColumn("_y", run(feature_array())).select(*df.columns, "_y.*")


def score_frame(engineered: DataFrame, model: LoadModel, forest: IsolationForest) -> DataFrame:
    """The scored frame: prediction, residual, band, anomaly flag and severity."""
    scored = isolation_forest_score(load_predict(engineered, model), forest)
    lower, upper = rules.band(F.col("prediction"), F.col("q_low"), F.col("q_high"))
    flag = F.col("label") == -1
    return scored.select(
        "building_id", "timestamp",
        F.col("meter_reading").alias("meter_reading_kwh"),
        F.col("air_temperature").alias("outdoor_temperature_c"),
        F.col("prediction").alias("predicted_kwh"),
        (F.col("meter_reading") - F.col("prediction")).alias("residual"),
        lower.alias("lower_bound_95"), upper.alias("upper_bound_95"),
        "anomaly_score", flag.alias("is_anomaly"),
        rules.residual_severity(flag, F.col("meter_reading"), F.col("prediction")).alias("severity"),
    )


def forecast_features(history: DataFrame, temperatures: DataFrame | None = None) -> DataFrame:
    """Feature rows of the next 24 hours per building.

    The 24-hour lag is looked up by time, else by place among the last 24
    rows; the one-hour lag follows the row before. At most 48 history rows
    per building are nested, so groups are bounded.
    """
    last = rows.newest(history, ["building_id"], [F.col("timestamp").desc()], 48)
    recent = (
        last.groupBy("building_id")
        .agg(F.array_sort(F.collect_list(F.struct("timestamp", "meter_reading", "air_temperature"))).alias("_s"))
        .filter(F.size("_s") >= 24)
        .withColumn("_end", F.element_at("_s", -1).timestamp)
    )
    step = F.col("step")
    target = hours_after(F.col("_end"), step)

    def look(field: str, at: Column) -> Column:
        hit = F.filter("_s", lambda s: s.timestamp == hours_after(at, -24))
        place = F.element_at(F.col("_s"), (F.size("_s") - 24 + step).cast("int"))
        return F.when(F.size(hit) > 0, F.get(hit, F.lit(0)).getField(field)).otherwise(place.getField(field))

    future = recent.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(HORIZON)))).withColumn("timestamp", target)
    before = F.when(step > 1, hours_after(F.col("_end"), step - 1))
    place_before = F.element_at(F.col("_s"), F.greatest(F.lit(1), F.size("_s") - 24 + step - 1).cast("int"))
    hit_before = F.filter("_s", lambda s: s.timestamp == hours_after(before, -24))
    chained = F.when(F.size(hit_before) > 0, F.get(hit_before, F.lit(0)).meter_reading).otherwise(place_before.meter_reading)
    lag_1h = F.when(step == 1, F.element_at("_s", -1).meter_reading).otherwise(chained)
    out = future.withColumns(
        {
            "lag_24h": half_up(look("meter_reading", F.col("timestamp")), 2),
            "lag_1h": half_up(lag_1h, 2),
            "air_temperature": half_up(look("air_temperature", F.col("timestamp")), 2),
        }
    )
    if temperatures is not None:
        given = temperatures.select("building_id", "timestamp", F.col("air_temperature").alias("_t"))
        out = out.join(given, ["building_id", "timestamp"], "left").withColumn(
            "air_temperature", half_up(F.coalesce("_t", "air_temperature"), 2)
        )
    return features.calendar_features(out).select("building_id", "timestamp", "step", *S.LOAD_FEATURES)


FORECAST_SCHEMA = (
    "building_id STRING, timestamp TIMESTAMP_NTZ, step INT, predicted_kwh DOUBLE, "
    "q_low DOUBLE, q_high DOUBLE, outdoor_temperature_c DOUBLE"
)


def recursive_forecast(history: DataFrame, model: LoadModel) -> DataFrame:
    """24 hours ahead, each prediction feeding the next one-hour lag.

    The 24 feature rows of a building travel as one array; a task advances
    all its buildings together, one step at a time, on broadcast trees.
    """
    shared = history.sparkSession.sparkContext.broadcast(model)
    row = F.struct("step", "timestamp", *[F.col(c).cast("double").alias(c) for c in S.LOAD_FEATURES])
    nested = forecast_features(history).groupBy("building_id").agg(F.array_sort(F.collect_list(row)).alias("steps"))
    flat = nested.select(
        "building_id", F.col("steps.timestamp").alias("ts"),
        *[F.col(f"steps.{c}").alias(c) for c in S.LOAD_FEATURES],
    )
    lag = S.LOAD_FEATURES.index("lag_1h")

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            if batch.empty:
                continue
            cube = np.stack([np.stack(batch[c].to_numpy()) for c in S.LOAD_FEATURES], axis=2)
            before = None
            parts = []
            for step in range(cube.shape[1]):
                x = cube[:, step, :].copy()
                if before is not None:
                    x[:, lag] = before
                predicted = np.round(np.maximum(0.0, m.point.predict(x)), 2)
                before = predicted
                parts.append(
                    pd.DataFrame(
                        {
                            "building_id": batch["building_id"], "timestamp": [t[step] for t in batch["ts"]],
                            "step": step + 1, "predicted_kwh": predicted,
                            "q_low": m.quantiles[0].predict(x), "q_high": m.quantiles[-1].predict(x),
                            "outdoor_temperature_c": x[:, S.LOAD_FEATURES.index("air_temperature")],
                        }
                    )
                )
            yield pd.concat(parts, ignore_index=True)

    forecast = flat.mapInPandas(advance, FORECAST_SCHEMA)
    lower, upper = rules.band(F.col("predicted_kwh"), F.col("q_low"), F.col("q_high"))
    return forecast.select(
        "building_id", "timestamp", "predicted_kwh",
        lower.alias("lower_bound_95"), upper.alias("upper_bound_95"), "outdoor_temperature_c",
    )


def live_scale(series: DataFrame, model: LoadModel) -> DataFrame:
    """Ratio of a building's level to the level the model was trained on: building_id, scale."""
    observed = series.groupBy("building_id").agg(F.median("meter_reading").alias("_obs"))

    def predicted_median(df: DataFrame) -> DataFrame:
        return load_predict(features.engineer(df), model).groupBy("building_id").agg(F.median("prediction").alias("_pred"))

    def clip(c: Column) -> Column:
        return F.greatest(F.lit(0.05), F.least(F.lit(5.0), c))

    ratio = F.col("_obs") / F.col("_pred")
    usable = (F.col("_obs") > 0) & (F.col("_pred") > 0)
    first = observed.join(predicted_median(series), "building_id", "left").select(
        "building_id", "_obs",
        F.coalesce(F.when(usable & ~ratio.between(0.85, 1.18), clip(ratio)), F.lit(1.0)).alias("_s1"),
    )
    scaled = series.join(first.select("building_id", "_s1"), "building_id").withColumn(
        "meter_reading", F.col("meter_reading") / F.col("_s1")
    ).drop("_s1")
    second = first.join(predicted_median(scaled), "building_id", "left").withColumn("_pred", F.col("_pred") * F.col("_s1"))
    return second.select(
        "building_id",
        F.when(F.col("_s1") == 1.0, F.lit(1.0))
        .otherwise(F.coalesce(F.when(F.col("_pred") > 0, clip(F.col("_s1") * ratio)), F.lit(1.0)))
        .alias("scale"),
    )


def rescale(series: DataFrame, scale: DataFrame) -> DataFrame:
    return series.join(scale, "building_id").withColumn("meter_reading", F.col("meter_reading") / F.col("scale")).drop("scale")


def anchor_factor(observed: Column, predicted: Column) -> Column:
    """Extra factor where the forecast has drifted from the last day's median."""
    r = observed / predicted
    drifted = (predicted > 0) & (observed > 0) & ((r < 0.75) | (r > 1.35))
    return F.coalesce(F.when(drifted, F.greatest(F.lit(0.25), F.least(F.lit(4.0), r))), F.lit(1.0))


def anchored_forecast(series: DataFrame, model: LoadModel, scale: DataFrame | None = None) -> DataFrame:
    """Recursive forecast on the scaled series, scaled back and anchored to the last 24 hours."""
    scale = live_scale(series, model) if scale is None else scale
    forecast = recursive_forecast(rescale(series, scale), model)
    tail = rows.newest(series, ["building_id"], [F.col("timestamp").desc()], 24)
    observed = tail.groupBy("building_id").agg(F.median("meter_reading").alias("_obs"))
    level = forecast.groupBy("building_id").agg(F.median("predicted_kwh").alias("_med"))
    factor = (
        scale.join(observed, "building_id").join(level, "building_id")
        .select("building_id", (F.col("scale") * anchor_factor(F.col("_obs"), F.col("_med") * F.col("scale"))).alias("_f"))
    )
    lower, upper = rules.band(F.col("predicted_kwh"), F.col("lower_bound_95"), F.col("upper_bound_95"), F.col("_f"))
    return forecast.join(factor, "building_id").select(
        "building_id", "timestamp",
        half_up(F.col("predicted_kwh") * F.col("_f"), 2).alias("predicted_kwh"),
        half_up(lower, 2).alias("lower_bound_95"), half_up(upper, 2).alias("upper_bound_95"),
        "outdoor_temperature_c",
    )


def score_live_series(series: DataFrame, model: LoadModel, forest: IsolationForest, limit: int = 168) -> DataFrame:
    """Live hours scored at the model's level and returned at their own, last ``limit`` per building."""
    scale = live_scale(series, model)
    scored = score_frame(features.engineer(rescale(series, scale)), model, forest)
    last = rows.newest(scored, ["building_id"], [F.col("timestamp").desc()], limit).join(scale, "building_id")
    lower, upper = rules.band(F.col("predicted_kwh"), F.col("lower_bound_95"), F.col("upper_bound_95"), F.col("scale"))
    out = last.withColumns(
        {
            "meter_reading_kwh": half_up(F.col("meter_reading_kwh") * F.col("scale"), 2),
            "_p": half_up(F.col("predicted_kwh") * F.col("scale"), 2),
            "lower_bound_95": half_up(lower, 2),
            "upper_bound_95": half_up(upper, 2),
        }
    )
    return out.withColumn("predicted_kwh", F.col("_p")).withColumn(
        "residual", half_up(F.col("meter_reading_kwh") - F.col("predicted_kwh"), 2)
    ).drop("scale", "_p")


ARX_TERMS = ["one", "lag_1h", "lag_24h", "air_temperature"]


def arx_fit(train: DataFrame, window: int = 336) -> DataFrame:
    """Per building: weights of lags and temperature from the last ``window`` training rows.

    The normal equations are sums of products, so rows are reduced before
    they leave their task; only a 4 x 4 system per building is solved.
    """
    last = rows.newest(train, ["building_id"], [F.col("timestamp").desc()], window).withColumn("one", F.lit(1.0))
    products = [
        F.sum(F.col(a) * F.col(b)).alias(f"m_{i}_{j}") for i, a in enumerate(ARX_TERMS) for j, b in enumerate(ARX_TERMS)
    ]
    sums = last.groupBy("building_id").agg(*products, *[F.sum(F.col(a) * F.col("meter_reading")).alias(f"v_{i}") for i, a in enumerate(ARX_TERMS)])
    size = len(ARX_TERMS)

    @F.pandas_udf("array<double>")
    def solve(matrix: pd.Series, vector: pd.Series) -> pd.Series:
        return pd.Series(
            [np.linalg.lstsq(np.reshape(m, (size, size)), np.asarray(v), rcond=None)[0] for m, v in zip(matrix, vector)]
        )

    matrix = F.array(*[F.col(f"m_{i}_{j}") for i in range(size) for j in range(size)])
    return sums.select("building_id", solve(matrix, F.array(*[F.col(f"v_{i}") for i in range(size)])).alias("weights"))


def arx_predict(test: DataFrame, weights: DataFrame) -> DataFrame:
    w = F.col("weights")
    value = F.get(w, F.lit(0))
    for i, name in enumerate(ARX_TERMS[1:], start=1):
        value = value + F.get(w, F.lit(i)) * F.col(name)
    return test.join(weights, "building_id").withColumn("prediction", value).drop("weights")


def arx_horizons(test: DataFrame, weights: DataFrame, horizon: int = HORIZON, model: str = "seasonal_arx") -> DataFrame:
    """Rolling-origin predictions of the fitted weights, each feeding the next one-hour lag.

    A window frame gives each origin its next ``horizon`` feature rows; an aggregate over that array carries
    the last prediction, all inside the JVM. Columns as :func:`evaluation.horizon_predictions`, rounded to
    two decimals.
    """
    row = F.struct("timestamp", F.col("meter_reading").alias("actual"), "lag_1h", "lag_24h", "air_temperature")
    ahead = F.collect_list(row).over(features.series_window().rowsBetween(1, horizon))
    nested = test.withColumn("_a", ahead).select("building_id", F.col("timestamp").alias("origin_timestamp"), "_a").filter(F.size("_a") > 0)
    w = F.col("weights")

    def step(state: Column, x: Column) -> Column:
        before = F.coalesce(F.try_element_at(state, F.lit(-1)), x.lag_1h)
        value = F.get(w, F.lit(0)) + F.get(w, F.lit(1)) * before + F.get(w, F.lit(2)) * x.lag_24h + F.get(w, F.lit(3)) * x.air_temperature
        return F.concat(state, F.array(value))

    walked = nested.join(weights, "building_id").withColumn("_p", F.aggregate("_a", F.array().cast("array<double>"), step))
    long = walked.select("building_id", "origin_timestamp", F.posexplode(F.arrays_zip("_a", "_p")).alias("_h", "_z"))
    return long.select(
        F.lit(model).alias("model"), "building_id", "origin_timestamp", (F.col("_h") + 1).alias("horizon_h"),
        F.col("_z._a.timestamp").alias("target_timestamp"), F.col("_z._a.actual").alias("actual"), half_up(F.col("_z._p"), 2).alias("prediction"),
    ).filter(F.col("actual").isNotNull() & F.col("prediction").isNotNull())


# A forecaster is a pair: fit(train) -> model, predict(model, test) -> test with `prediction`.
Forecaster = tuple[Callable[[DataFrame], object], Callable[[object, DataFrame], DataFrame]]


def standard_forecasters(rounds: int = 350, rate: float = 0.05) -> dict[str, Forecaster]:
    return {
        "seasonal_naive": (lambda train: None, lambda _, test: test.withColumn("prediction", F.col("lag_24h"))),
        "seasonal_arx": (arx_fit, lambda weights, test: arx_predict(test, weights)),
        "gbt": (lambda train: gbt_forecaster(train, rounds=rounds, rate=rate), gbt_predict),
        "gbt_median": (lambda train: quantile_forecaster(train, [0.5], rounds=rounds, rate=rate)[0], gbt_predict),
    }


def model_size(model) -> int:
    """Bytes of a model as it would be stored: arrays of trees, or a table of weights."""
    if model is None:
        return 0
    if isinstance(model, DataFrame):
        return model.count() * len(ARX_TERMS) * 8
    return len(pickle.dumps(model))


def model_leaderboard(split: DataFrame, forecasters: dict[str, Forecaster]) -> DataFrame:
    """Metrics, times, size and training rows of each forecaster; one row per model."""
    spark = split.sparkSession
    split = cut_lineage(split, "leaderboard")
    train, test = split.filter(F.col("part") == "train"), split.filter(F.col("part") == "test")
    train_rows = train.count()
    table = []
    for name, (fit, predict) in forecasters.items():
        begun = time.perf_counter()
        model = fit(train)
        fitted = time.perf_counter()
        scored = predict(model, test).select(F.col("meter_reading").alias("actual"), "prediction")
        row = evaluation.forecast_metrics(scored).first()
        done = time.perf_counter()
        table.append(
            (name, row.mae, row.rmse, row.mape, row.r2, fitted - begun, 1000.0 * (done - fitted) / max(row["rows"], 1), model_size(model), train_rows)
        )
    return spark.createDataFrame(
        table,
        "model STRING, mae DOUBLE, rmse DOUBLE, mape DOUBLE, r2 DOUBLE, training_time_s DOUBLE, "
        "mean_latency_ms DOUBLE, size_bytes LONG, train_rows LONG",
    )


def grid_search(train: DataFrame, candidates: list[dict], k: int = 3, compared: int = 3) -> DataFrame:
    """Mean validation RMSE over expanding folds per parameter set; the best of those that met all folds is marked.

    The folds are reduced to cells once, and in each fold all sets that are left grow side by side. Where
    at least ``compared`` met a fold that is not the last, those whose mean so far is above their median
    are pruned: (params, mean_rmse, folds, pruned, is_best), with the mean over the folds a set met.
    """
    folds = features.expanding_folds(train, k)
    part = F.col("fold") * 2 + (F.col("role") == "validate").cast("int")
    data = boosting.Data(folds, S.LOAD_FEATURES, "meter_reading", KEYS, any(p.get("quantile") is not None for p in candidates), part)
    errors: dict[int, list[float]] = {c: [] for c in range(len(candidates))}
    left = list(errors)
    numbers = sorted(r.fold for r in folds.select("fold").distinct().collect())  # at most k
    for met, fold in enumerate(numbers, start=1):
        specs = [boosting.Spec(**candidates[c], learn=2 * fold, check=2 * fold + 1) for c in left]
        for c, fitted in zip(left, data.fit(specs)):
            errors[c].append(fitted.rmse)
        if len(left) >= compared and met < len(numbers):
            middle = float(np.median([np.mean(errors[c]) for c in left]))
            left = [c for c in left if np.mean(errors[c]) <= middle]
    best = min(left, key=lambda c: np.mean(errors[c]))
    return train.sparkSession.createDataFrame(
        [(str(params), float(np.mean(errors[c])), len(errors[c]), c not in left, c == best) for c, params in enumerate(candidates)],
        "params STRING, mean_rmse DOUBLE, folds INT, pruned BOOLEAN, is_best BOOLEAN",
    )


def recursive_grid(test: DataFrame, model: LoadModel, horizon: int = HORIZON) -> DataFrame:
    """Rolling-origin recursive predictions of the load model: one array of steps per origin.

    An origin is joined with its next ``horizon`` feature rows by a window
    frame; within a batch all origins advance together.
    """
    shared = test.sparkSession.sparkContext.broadcast(model)
    ahead = F.collect_list(F.struct("timestamp", "meter_reading", feature_array().alias("x"))).over(
        features.series_window().rowsBetween(1, horizon)
    )
    nested = test.select("building_id", F.col("timestamp").alias("origin_timestamp"), ahead.alias("_a")).select(
        "building_id", "origin_timestamp", F.col("_a.timestamp").alias("ts"), F.col("_a.meter_reading").alias("y"),
        F.col("_a.x").alias("x"),
    )
    lag = S.LOAD_FEATURES.index("lag_1h")
    arrays = "ts ARRAY<TIMESTAMP_NTZ>, y ARRAY<DOUBLE>, predictions ARRAY<DOUBLE>, q_low ARRAY<DOUBLE>, q_high ARRAY<DOUBLE>"

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            n = batch["x"].map(len).to_numpy()
            point = np.full((len(batch), horizon), np.nan)
            low, high = point.copy(), point.copy()
            before = np.full(len(batch), np.nan)
            for step in range(horizon):
                alive = np.flatnonzero(n > step)
                if len(alive) == 0:
                    break
                x = np.stack([np.asarray(batch["x"].iloc[i][step], dtype=float) for i in alive])
                if step > 0:
                    x[:, lag] = before[alive]
                before[alive] = m.point.predict(x)
                point[alive, step] = before[alive]
                low[alive, step], high[alive, step] = m.quantiles[0].predict(x), m.quantiles[-1].predict(x)
            cut = {
                name: [row[:size] for row, size in zip(grid, n)]
                for name, grid in (("predictions", point), ("q_low", low), ("q_high", high))
            }
            yield batch[["building_id", "origin_timestamp", "ts", "y"]].assign(**cut)

    steps = nested.mapInPandas(advance, f"building_id STRING, origin_timestamp TIMESTAMP_NTZ, {arrays}")
    return steps.select(
        "building_id", "origin_timestamp",
        F.posexplode(F.arrays_zip("ts", "y", "predictions", "q_low", "q_high")).alias("_h", "_z"),
    ).select(
        "building_id", "origin_timestamp", (F.col("_h") + 1).alias("horizon_h"), F.col("_z.ts").alias("target_timestamp"),
        F.col("_z.y").alias("actual"), F.col("_z.predictions").alias("prediction"), F.col("_z.q_low"), F.col("_z.q_high"),
    )
