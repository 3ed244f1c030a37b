"""Forecast evaluation: errors, horizons, intervals and model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.numeric import fixed, half_up
from wattloom.operators import rows
from wattloom.operators.features import series_window

def error() -> Column:
    return F.col("actual") - F.col("prediction")


def seasonal_naive(series: DataFrame) -> DataFrame:
    """Forecast for an hour: the reading 24 hours earlier, at every horizon up to 24."""
    return series.withColumn("prediction", F.lag("meter_reading", 24).over(series_window())).filter(
        F.col("prediction").isNotNull()
    )


#: The spacing of doubles at 1; a smaller actual counts as this in a percentage.
LEAST_ACTUAL = 2.0**-52


def share() -> Column:
    """Absolute error as a share of the actual value, which is held away from zero."""
    return F.abs(error()) / F.greatest(F.abs(F.col("actual")), F.lit(LEAST_ACTUAL))


def forecast_metrics(predictions: DataFrame, *keys: str) -> DataFrame:
    """MAE, RMSE, MAPE in percent and R2; one pass of mergeable sums.

    R2 of constant actuals is 1 where all predictions are right, else 0.
    """
    fit = F.lit(1.0) - F.try_divide(F.avg(error() * error()), F.var_pop("actual"))
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        half_up(F.avg(F.abs(error())), 4).alias("mae"),
        half_up(F.sqrt(F.avg(error() * error())), 4).alias("rmse"),
        half_up(F.avg(share()) * 100, 4).alias("mape"),
        half_up(F.coalesce(fit, F.when(F.avg(error() * error()) == 0, 1.0).otherwise(0.0)), 6).alias("r2"),
    )


def pinball(actual: Column, quantile: Column, q: float) -> Column:
    gap = actual - quantile
    return F.when(gap >= 0, gap * q).otherwise(gap * (q - 1))


def pinball_coverage(predictions: DataFrame, *keys: str) -> DataFrame:
    """Pinball loss of three quantiles, coverage and mean width of the 95% band."""
    y = F.col("actual")
    inside = y.between(F.col("q_low"), F.col("q_high")).cast("double")
    return predictions.groupBy(*keys).agg(
        half_up(F.avg(pinball(y, F.col("q_low"), 0.025)), 4).alias("pinball_q2_5"),
        half_up(F.avg(pinball(y, F.col("q_mid"), 0.5)), 4).alias("pinball_q50"),
        half_up(F.avg(pinball(y, F.col("q_high"), 0.975)), 4).alias("pinball_q97_5"),
        half_up(F.avg(inside), 4).alias("coverage_95"),
        half_up(F.avg(F.col("q_high") - F.col("q_low")), 4).alias("mean_width"),
    )


def rolling_origin(test: DataFrame, horizon: int = 24) -> DataFrame:
    """Pairs of an origin and each of the next ``horizon`` test hours.

    Every target row looks back at its last ``horizon`` rows in one window and
    explodes them: no self join, one shuffle. Adds the origin's time and
    reading; all target columns stay for the models to use.
    """
    past = F.collect_list(F.struct(F.col("timestamp").alias("ts"), F.col("meter_reading").alias("kwh"))).over(
        series_window().rowsBetween(-horizon, -1)
    )
    return (
        test.withColumn("_past", F.reverse(past))
        .select(*test.columns, F.posexplode("_past").alias("_h", "_o"))
        .withColumn("horizon_h", F.col("_h") + 1)
        .withColumn("origin_timestamp", F.col("_o.ts"))
        .withColumn("origin_reading", F.col("_o.kwh"))
        .drop("_h", "_o")
    )


def horizon_predictions(test: DataFrame, models: dict[str, Column], horizon: int = 24) -> DataFrame:
    """Long predictions of several models over the rolling origin; null pairs are dropped."""
    pairs = rolling_origin(test, horizon)
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), c.cast("double").alias("prediction")) for n, c in models.items()]))
    return (
        pairs.withColumn("_m", long)
        .select(
            "_m.model", "building_id", "origin_timestamp", F.col("horizon_h").cast("int").alias("horizon_h"),
            F.col("timestamp").alias("target_timestamp"), F.col("meter_reading").alias("actual"), "_m.prediction",
        )
        .filter(F.col("actual").isNotNull() & F.col("prediction").isNotNull())
    )


def horizon_scoring(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model", "horizon_h").agg(
        half_up(F.avg(F.abs(error())), 4).alias("mae"), half_up(F.sqrt(F.avg(error() * error())), 4).alias("rmse")
    )


def interval_coverage(bands: DataFrame) -> DataFrame:
    """Coverage and width per horizon and pooled (horizon 0), for the learned and the RMSE band.

    ``bands``: horizon_h, actual, prediction, q_low, q_high, half_width.
    """
    learned = F.struct(
        F.lit("learned_quantile").alias("method"),
        F.greatest(F.lit(0.0), F.least("q_low", "prediction")).alias("lo"),
        F.greatest("q_high", "prediction").alias("hi"),
    )
    constant = F.struct(
        F.lit("fixed_rmse").alias("method"),
        F.greatest(F.lit(0.0), F.col("prediction") - F.col("half_width")).alias("lo"),
        (F.col("prediction") + F.col("half_width")).alias("hi"),
    )
    long = bands.select("horizon_h", "actual", F.explode(F.array(learned, constant)).alias("b")).select(
        "horizon_h", F.col("b.method").alias("method"),
        F.col("actual").between(F.col("b.lo"), F.col("b.hi")).cast("double").alias("hit"),
        (F.col("b.hi") - F.col("b.lo")).alias("width"),
    )
    by_horizon, pooled = [F.col("horizon_h"), F.col("method")], [F.col("method")]
    return (
        long.groupingSets([by_horizon, pooled], "horizon_h", "method")
        .agg(half_up(F.avg("hit"), 6).alias("coverage"), half_up(F.avg("width"), 4).alias("mean_width"))
        .withColumn("horizon_h", F.coalesce("horizon_h", F.lit(0)))
    )


def error_by_hour(predictions: DataFrame) -> DataFrame:
    return (
        predictions.filter(F.col("horizon_h") == 1)
        .groupBy("model", F.hour("target_timestamp").alias("hour"))
        .agg(half_up(F.avg(F.abs(error())), 4).alias("mean_abs_error"))
    )


def best_at_horizon(by_horizon: DataFrame, horizon: int) -> DataFrame:
    """Model with the lowest MAE at a horizon, or at the largest there is."""
    chosen = by_horizon.agg(
        F.coalesce(F.max(F.when(F.col("horizon_h") == horizon, F.col("horizon_h"))), F.max("horizon_h")).alias("horizon_h")
    )
    best = F.min_by(F.struct("model", "mae"), F.struct("mae", "model"))
    return by_horizon.join(chosen, "horizon_h").groupBy("horizon_h").agg(best.alias("b")).select("horizon_h", "b.*")


def model_recommendation(by_horizon: DataFrame, results: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Ranking by mean MAE; models within the tolerance of the best compete on cost.

    The windows run over one row per model.
    """
    mean = by_horizon.groupBy("model").agg(half_up(F.avg("mae"), 6).alias("mean_mae"))
    cost = [F.col("latency_ms"), F.col("size_bytes"), F.col("model")]
    everyone = Window.partitionBy(F.lit(0))
    merged = mean.join(results.select("model", "latency_ms", "size_bytes"), "model", "left")
    return (
        merged.withColumn("rank", F.row_number().over(everyone.orderBy("mean_mae", *cost)))
        .withColumn("is_contender", F.col("mean_mae") <= F.min("mean_mae").over(everyone) * (1 + tolerance))
        .withColumn(
            "recommended",
            F.col("is_contender") & (F.row_number().over(everyone.orderBy(F.col("is_contender").desc(), *cost)) == 1),
        )
    )


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))


def holdout_mape(predictions: DataFrame, *keys: str) -> DataFrame:
    """MAPE without zero targets; an ``error`` for non-finite values or nothing left."""
    ok = finite(F.col("actual")) & finite(F.col("prediction"))
    used = F.when(ok & (F.col("actual") != 0), F.abs(error() / F.col("actual")))
    sums = predictions.groupBy(*keys).agg(
        F.count_if(~ok).alias("bad"), F.count(used).alias("rows_used"), F.avg(used).alias("m")
    )
    problem = F.when(F.col("bad") > 0, "non-finite values").when(F.col("rows_used") == 0, "no non-zero target rows")
    return sums.withColumn("error", problem).select(
        *keys, "rows_used", F.when(F.col("error").isNull(), half_up(F.col("m") * 100, 6)).alias("mape_percent"), "error"
    )


def rolling_mape(predictions: DataFrame, length: int = 168) -> DataFrame:
    """MAPE over each building's last rows, by row count."""
    last = rows.newest(predictions, ["building_id"], [F.col("timestamp").desc()], length)
    return last.groupBy("building_id").agg(
        half_up(F.avg(share()) * 100, 2).alias("mape_percent"),
        F.count(F.lit(1)).alias("window_rows"),
    )


def champion_gate(holdout: DataFrame, bounds: DataFrame) -> DataFrame:
    """Promotes a challenger only without leakage and with a strictly lower MAPE.

    ``holdout``: building_id, timestamp, actual, champion, challenger;
    ``bounds``: building_id, train_end, champion_train_end (may be null).
    """
    long = holdout.select(
        "building_id", "timestamp", "actual",
        F.explode(F.array(*[F.struct(F.lit(n).alias("who"), F.col(n).alias("prediction")) for n in ("champion", "challenger")])).alias("_p"),
    ).select("building_id", "actual", "_p.*")
    scored = holdout_mape(long, "building_id", "who")
    start = holdout.groupBy("building_id").agg(F.min("timestamp").alias("holdout_start"))
    pair = scored.groupBy("building_id").agg(
        *[F.max(F.when(F.col("who") == w, F.col("mape_percent"))).alias(f"{w}_mape") for w in ("champion", "challenger")],
        F.max("error").alias("error"),
    )
    leak = "Temporal leakage detected: holdout window must start strictly after "
    reason = (
        F.when(F.col("train_end") >= F.col("holdout_start"), leak + "training cutoff.")
        .when(F.col("champion_train_end") >= F.col("holdout_start"), leak + "active champion training cutoff.")
        .when(F.col("error").isNotNull(), F.col("error"))
    )
    worse = F.format_string(
        "Challenger MAPE (%s%%) is not strictly lower than champion MAPE (%s%%).",
        fixed(F.col("challenger_mape"), 6), fixed(F.col("champion_mape"), 6),
    )
    better = F.col("challenger_mape") < F.col("champion_mape")
    joined = pair.join(start, "building_id").join(bounds, "building_id").withColumn("_failed", reason)
    return joined.select(
        "building_id",
        F.when(F.col("_failed").isNull(), F.col("champion_mape")).alias("champion_mape"),
        F.when(F.col("_failed").isNull(), F.col("challenger_mape")).alias("challenger_mape"),
        F.when(F.col("_failed").isNotNull(), "failed").when(better, "promoted").otherwise("rejected").alias("outcome"),
        F.coalesce("_failed", F.when(~better, worse)).alias("reason"),
    )
