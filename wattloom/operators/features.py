"""Model features, splits and series windows.

Windows partitioned by building run over the hourly series, which has one
row per building and hour: its length grows with the calendar only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions import rules
from wattloom.functions.numeric import elapsed, hours_after, micros
from wattloom.operators import rows

def series_window():
    return Window.partitionBy("building_id").orderBy("timestamp")


def calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns(rules.calendar(F.col("timestamp")))


def lag_features(series: DataFrame) -> DataFrame:
    """Lags by position (1 and 24 rows back); rows with any null are dropped."""
    return series.withColumns(
        {
            "lag_1h": F.lag("meter_reading", 1).over(series_window()),
            "lag_24h": F.lag("meter_reading", 24).over(series_window()),
        }
    ).dropna()


def engineer(series: DataFrame) -> DataFrame:
    """Calendar and lags together: the training and scoring frame."""
    return lag_features(calendar_features(series))


def lag_by_timestamp(series: DataFrame) -> DataFrame:
    """Lags by exact time, positional where that hour is absent.

    A range frame of exactly one instant replaces a self join: one shuffle.
    """
    clock = Window.partitionBy("building_id").orderBy("_s")
    out = series.withColumn("_s", F.floor(micros(F.col("timestamp")) / 1_000_000))
    for name, hours in (("lag_1h", 1), ("lag_24h", 24)):
        at = clock.rangeBetween(-3600 * hours, -3600 * hours)
        out = out.withColumn(
            name, F.coalesce(F.max("meter_reading").over(at), F.lag("meter_reading", hours).over(clock))
        )
    return out.drop("_s")


def context_lags(target: DataFrame, context: DataFrame | None = None, mode: str = "context") -> DataFrame:
    """Target rows with lags that may reach into a context table.

    ``context`` uses prior rows (24 at least per building, else the target
    alone), ``drop`` loses rows without lags, ``backfill`` takes the next
    known lag.
    """
    own = target.withColumn("_target", F.lit(True))
    if mode == "context":
        if context is None:
            raise ValueError("mode 'context' needs a context table")
        enough = context.groupBy("building_id").count().filter(F.col("count") >= 24)
        prior = context.join(enough, "building_id", "left_semi").withColumn("_target", F.lit(False))
        own = own.unionByName(prior)
    lagged = calendar_features(own).withColumns(
        {"lag_1h": F.lag("meter_reading", 1).over(series_window()), "lag_24h": F.lag("meter_reading", 24).over(series_window())}
    )
    lagged = lagged.filter("_target").drop("_target")
    if mode == "drop":
        return lagged.dropna(subset=["lag_1h", "lag_24h"])
    reverse = (
        Window.partitionBy("building_id").orderBy(F.col("timestamp").desc()).rowsBetween(Window.unboundedPreceding, 0)
    )
    return lagged.withColumns({c: F.last(c, ignorenulls=True).over(reverse) for c in ("lag_1h", "lag_24h")})


def chronological_split(df: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Adds ``part``: the first ``floor(n * ratio)`` rows of a building train."""
    whole = Window.partitionBy("building_id")
    return (
        df.withColumn("position", F.row_number().over(series_window()))
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("part", F.when(F.col("position") <= F.floor(F.col("_n") * F.lit(ratio)), "train").otherwise("test"))
        .drop("_n")
    )


def expanding_folds(train: DataFrame, k: int = 3) -> DataFrame:
    """Rows with ``fold`` and ``role``; fold i trains on i blocks and validates on the next."""
    numbered = train.withColumn("_r", F.row_number().over(series_window()) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("building_id"))
    )
    small = F.col("_n") < (k + 1) * 2
    block = F.floor(F.col("_n") / (k + 1))
    cut = F.when(small, F.greatest(F.lit(1), F.floor(F.col("_n") * 0.8))).otherwise(F.col("fold") * block)
    stop = F.when(small | (F.col("fold") == k), F.col("_n")).otherwise((F.col("fold") + 1) * block)
    folds = F.when(small, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.lit(k)))
    return (
        numbered.withColumn("fold", F.explode(folds))
        .withColumn("role", F.when(F.col("_r") < cut, "train").when(F.col("_r") < stop, "validate"))
        .filter(F.col("role").isNotNull())
        .drop("_r", "_n")
    )


def check_folds(folds: DataFrame, train: DataFrame) -> DataFrame:
    """Fold rows that lie after the training end; must be empty."""
    end = train.groupBy("building_id").agg(F.max("timestamp").alias("_end"))
    return folds.join(end, "building_id").filter(F.col("timestamp") > F.col("_end")).drop("_end")


def scale_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Standardises with mean and population deviation of the training rows only."""
    fitted = df.filter(F.col("part") == "train").groupBy("building_id").agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    scaled = {
        f"{c}_scaled": (F.col(c) - F.col(f"_m_{c}"))
        / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        for c in columns
    }
    return df.join(fitted, "building_id").withColumns(scaled).select(*df.columns, *scaled)


def sequence_windows(series: DataFrame, columns: list[str], target: str, n_in: int = 168, n_out: int = 24) -> DataFrame:
    """Complete sliding inputs (``n_in`` rows) and the next ``n_out`` targets as arrays."""
    past = series_window().rowsBetween(-(n_in - 1), 0)
    future = series_window().rowsBetween(1, n_out)
    return (
        series.withColumn("inputs", F.collect_list(F.array(*columns)).over(past))
        .withColumn("targets", F.collect_list(target).over(future))
        .filter((F.size("inputs") == n_in) & (F.size("targets") == n_out))
        .select("building_id", "timestamp", "inputs", "targets")
    )


def serving_window(base: DataFrame, now: str, length: int = 720) -> DataFrame:
    """The stretch that ends on the same weekday and hour as ``now``, moved to end there."""
    moment = F.date_trunc("hour", F.lit(now).cast("timestamp_ntz")).cast("timestamp_ntz")
    whole = Window.partitionBy("building_id")
    match = (F.weekday("timestamp") == F.weekday(moment)) & (F.hour("timestamp") == F.hour(moment))
    indexed = base.withColumn("_i", F.row_number().over(series_window()) - 1)
    late = F.max(F.when(match & (F.col("_i") >= length - 1), F.col("_i"))).over(whole)
    any_match = F.max(F.when(match, F.col("_i"))).over(whole)
    return (
        indexed.withColumn("_end", F.coalesce(late, any_match))
        .withColumn("_end_ts", F.max(F.when(F.col("_i") == F.col("_end"), F.col("timestamp"))).over(whole))
        .filter(F.col("_i").between(F.col("_end") - length + 1, F.col("_end")))
        .withColumn("timestamp", F.col("timestamp") + (moment - F.col("_end_ts")))
        .drop("_i", "_end", "_end_ts")
    )


def latest_per_zone(zones: DataFrame, readings: DataFrame) -> DataFrame:
    """Every zone with its newest reading, null when it has none."""
    newest = readings.groupBy("building_id", "zone_id").agg(
        F.max_by(
            F.struct("timestamp", "meter_reading_kwh", "outdoor_temperature_c", "relative_humidity_pct"),
            F.struct("timestamp", "id"),
        ).alias("_l")
    )
    return zones.join(newest, ["building_id", "zone_id"], "left").select(*zones.columns, "_l.*")


def building_history(readings: DataFrame, limit: int = 168, zone: str | None = None) -> DataFrame:
    """Last readings of each building, or of one zone; no zone means its totals only."""
    chosen = readings.filter(F.col("zone_id").eqNullSafe(F.lit(zone)))
    return rows.newest(chosen, ["building_id"], [F.col("timestamp").desc(), F.col("id").desc()], limit)


def recent_scope_series(readings: DataFrame, scope: str = "building_id", limit: int = 168) -> DataFrame:
    """Sum over a scope's meters for its last distinct timestamps.

    Summing first makes timestamps distinct, so the limit needs no dense rank
    and no second pass over the readings.
    """
    points = readings.groupBy(scope, "timestamp").agg(F.sum("meter_reading_kwh").alias("meter_reading_kwh"))
    return rows.newest(points, [scope], [F.col("timestamp").desc()], limit)


def meter_hourly_rates(readings: DataFrame, history: int = 20) -> DataFrame:
    """Each reading with the hourly rates of up to ``history`` readings before it, newest first.

    An ``interval_seconds`` that comes with a reading stays; else it is the gap to the reading before.
    """
    given = F.col("interval_seconds") if "interval_seconds" in readings.columns else F.lit(None).cast("double")
    spread, keys = rows.with_history(readings, ["meter_id"], "timestamp", "id", ["meter_reading_kwh"], history)
    order = Window.partitionBy(*keys).orderBy("timestamp", "id")
    gap = elapsed(F.col("timestamp"), F.lag("timestamp").over(order))
    return (
        spread.withColumn("_dt", gap)
        .withColumn(
            "_rate",
            F.when(
                F.col("_dt").between(1, 7200),
                F.col("meter_reading_kwh") * (F.lit(3600.0) / F.least(F.col("_dt"), F.lit(3600.0))),
            ),
        )
        .withColumn("recent_meter_hourly_kwhs", F.reverse(F.collect_list("_rate").over(order.rowsBetween(1 - history, -1))))
        .withColumn(
            "interval_seconds",
            F.coalesce(given, F.when((F.col("_dt") > 0) & (F.col("_dt") <= 3600), F.col("_dt")), F.lit(3600.0)),
        )
        .filter(~F.col("_copy"))
        .drop("_dt", "_rate", "_copy", "_bucket")
    )


def run_history(runs: DataFrame) -> DataFrame:
    """Runs, newest first; a malformed or missing timestamp comes last."""
    at = F.try_to_timestamp(F.col("timestamp"))
    return runs.withColumn("run_at", at.cast("timestamp_ntz")).orderBy(F.col("run_at").desc_nulls_last(), "run_id")


def append_run(run: DataFrame, path: str) -> None:
    run.write.mode("append").parquet(path)


def temperature_proxy(series: DataFrame, horizon: int = 24) -> DataFrame:
    """Future hours with the temperature of 24 hours earlier, or of the same place in the last 24."""
    last = rows.newest(series, ["building_id"], [F.col("timestamp").desc()], 48)
    recent = last.groupBy("building_id").agg(
        F.max("timestamp").alias("_end"), F.array_sort(F.collect_list(F.struct("timestamp", "air_temperature"))).alias("_s")
    )
    future = recent.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "timestamp", hours_after(F.col("_end"), F.col("step"))
    )
    at = F.filter("_s", lambda s: s.timestamp == hours_after(F.col("timestamp"), -24))
    place = F.try_element_at(F.col("_s"), (F.size("_s") - 24 + F.col("step")).cast("int"))
    return future.select(
        "building_id", "timestamp", "step",
        F.when(F.size(at) > 0, at[0].air_temperature).otherwise(place.air_temperature).alias("air_temperature"),
    )
