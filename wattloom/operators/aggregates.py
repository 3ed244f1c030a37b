"""Aggregations: hourly, daily and monthly series, metrics and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.functions import settings as S
from wattloom.functions.numeric import half_up, trunc_ntz
from wattloom.operators import rows


def hourly_building_series(readings: DataFrame, since: str, now: str) -> DataFrame:
    """Load per building and completed hour.

    Zone rows win over building totals, so nothing is counted twice. One
    partial aggregate before the shuffle: a hot building ships one row per
    hour and task. The result is bounded by the calendar, not by the readings.
    """
    end = trunc_ntz("hour", F.lit(now).cast("timestamp_ntz"))
    kwh, zone = F.col("meter_reading_kwh"), F.col("zone_id")
    return (
        readings.filter((F.col("timestamp") >= F.lit(since).cast("timestamp_ntz")) & (F.col("timestamp") < end))
        .groupBy("building_id", trunc_ntz("hour", F.col("timestamp")).alias("timestamp"))
        .agg(
            half_up(
                F.coalesce(F.sum(F.when(zone.isNotNull(), kwh)), F.sum(F.when(zone.isNull(), kwh)), F.lit(0.0)), 4
            ).alias("meter_reading_kwh"),
            half_up(F.coalesce(F.avg("outdoor_temperature_c"), F.lit(S.DEFAULT_TEMPERATURE_C)), 2).alias(
                "outdoor_temperature_c"
            ),
        )
    )


def on_full_grid(series: DataFrame, buildings: DataFrame, start: str, end: str) -> DataFrame:
    """Every hour from ``start`` to ``end`` for each building; gaps are null."""
    hours = F.sequence(
        F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr("interval 1 hour")
    )
    grid = buildings.select("building_id", F.explode(hours).alias("timestamp"))
    return grid.join(series, ["building_id", "timestamp"], "left").select(
        "building_id", "timestamp",
        F.col("meter_reading_kwh").alias("meter_reading"),
        F.col("outdoor_temperature_c").alias("air_temperature"),
    )


def energy_metrics(scored: DataFrame) -> DataFrame:
    """Totals, peak, baseline, anomalies and their waste over a scored window."""
    waste = F.coalesce(F.sum(F.when(F.col("is_anomaly"), F.greatest(F.col("residual"), F.lit(0.0)))), F.lit(0.0))
    return scored.groupBy("building_id").agg(
        half_up(F.sum("meter_reading_kwh"), 1).alias("total_consumption_kwh"),
        half_up(F.max("meter_reading_kwh"), 1).alias("peak_demand_kw"),
        half_up(F.sum("predicted_kwh"), 1).alias("predicted_baseline_kwh"),
        F.count_if("is_anomaly").alias("total_anomalies_detected"),
        half_up(waste, 1).alias("estimated_waste_kwh"),
        half_up(waste * S.TARIFF_VND, 0).alias("estimated_waste_cost_vnd"),
        half_up(waste * S.TARIFF_USD, 2).alias("estimated_waste_cost_usd"),
    )


def snapshot_number(name: str) -> Column:
    return F.get_json_object("snapshot", f"$.{name}").try_cast("double")


def live_energy_metrics(series: DataFrame, events: DataFrame, since: str) -> DataFrame:
    """30-day metrics of buildings with at least 24 hours of series."""
    load = (
        series.groupBy("building_id")
        .agg(
            F.count(F.lit(1)).alias("hours"),
            half_up(F.sum("meter_reading_kwh"), 1).alias("total_consumption_kwh"),
            half_up(F.max("meter_reading_kwh"), 1).alias("peak_demand_kw"),
        )
        .filter(F.col("hours") >= 24)
    )
    # a null status is not IGNORED for the dashboard, but `status <> 'IGNORED'` drops it in SQL
    kept = events.filter((F.col("status") != "IGNORED") & (F.col("timestamp") >= F.lit(since).cast("timestamp_ntz")))
    found = kept.groupBy("building_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(snapshot_number("estimated_waste_vnd"), F.lit(0.0))).alias("vnd"),
        F.sum(F.coalesce(snapshot_number("estimated_waste_usd"), F.lit(0.0))).alias("usd"),
    )
    return load.join(found, "building_id", "left").select(
        "building_id", "total_consumption_kwh", "peak_demand_kw",
        F.coalesce("n", F.lit(0)).alias("total_anomalies_detected"),
        half_up(F.coalesce("vnd", F.lit(0.0)), 0).alias("estimated_waste_cost_vnd"),
        half_up(F.coalesce("usd", F.lit(0.0)), 2).alias("estimated_waste_cost_usd"),
    )


def _totals_only(readings: DataFrame) -> DataFrame:
    return readings.filter(F.col("zone_id").isNull()) if "zone_id" in readings.columns else readings


def daily_breakdown(readings: DataFrame, value: str = "meter_reading") -> DataFrame:
    """Sum, maximum and count per UTC day; an absent reading counts as 0."""
    kwh = F.coalesce(F.col(value), F.lit(0.0))
    return (
        _totals_only(readings)
        .groupBy("building_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))
        .agg(
            half_up(F.sum(kwh), 2).alias("consumption_kwh"),
            half_up(F.greatest(F.max(kwh), F.lit(0.0)), 2).alias("peak_demand_kw"),
            F.count(F.lit(1)).alias("readings"),
        )
    )


def monthly_summary(readings: DataFrame, value: str = "meter_reading") -> DataFrame:
    """Month totals against the month before, on a gapless run of months.

    One aggregate per month; the days with data are a bit mask, so they need
    no second one. A month then brings along the empty months up to the next,
    which takes one window over months and no join.
    """
    kwh = F.coalesce(F.col(value), F.lit(0.0))
    day_bit = F.expr("shiftleft(1L, dayofmonth(timestamp))")
    months = _totals_only(readings).groupBy("building_id", F.trunc(F.to_date("timestamp"), "month").alias("m")).agg(
        half_up(F.sum(kwh), 2).alias("total"), half_up(F.max(kwh), 2).alias("peak"),
        F.count(F.lit(1)).alias("n"), F.bit_count(F.bit_or(day_bit)).alias("days"),
    )
    order = Window.partitionBy("building_id").orderBy("m")
    until = F.coalesce(F.add_months(F.lead("m").over(order), -1), F.col("m"))
    own = F.col("at") == F.col("m")
    before = (
        F.when(own & (F.col("_m") == F.add_months("m", -1)), F.col("_total"))
        .when(own, F.when(F.col("_m").isNotNull(), F.lit(0.0)))
        .when(F.col("at") == F.add_months("m", 1), F.col("total"))
        .otherwise(F.lit(0.0))
    )
    total = F.when(own, F.col("total")).otherwise(F.lit(0.0))
    return (
        months.withColumns({"_m": F.lag("m").over(order), "_total": F.lag("total").over(order), "_until": until})
        .withColumn("at", F.explode(F.sequence("m", "_until", F.expr("interval 1 month"))))
        .withColumn("before", before)
        .select(
            "building_id",
            F.date_format("at", "yyyy-MM").alias("month"),
            total.alias("total_consumption_kwh"),
            F.when(own, half_up(F.col("total") / F.col("days"), 2)).otherwise(F.lit(0.0)).alias("average_daily_kwh"),
            F.when(own, F.col("peak")).otherwise(F.lit(0.0)).alias("peak_demand_kw"),
            F.when(own, F.col("n")).otherwise(F.lit(0)).alias("reading_count"),
            half_up(
                F.when(F.col("before") > 0, (total - F.col("before")) / F.col("before") * 100), 1
            ).alias("change_vs_previous_month_pct"),
        )
    )


def severity_breakdown(incidents: DataFrame, *keys: str) -> DataFrame:
    return incidents.groupBy(
        "building_id", *keys, F.upper(F.coalesce("severity", F.lit("UNKNOWN"))).alias("severity")
    ).agg(
        F.count(F.lit(1)).alias("incidents"),
        half_up(F.sum(F.coalesce(snapshot_number("estimated_waste_vnd"), F.lit(0.0))), 0).alias("estimated_waste_vnd"),
    )


def monthly_report(readings: DataFrame, incidents: DataFrame, value: str = "meter_reading") -> DataFrame:
    """One row per building and month with nested days (31 at most) and severities."""
    month = F.substring("day", 1, 7)
    days = (
        daily_breakdown(readings, value)
        .groupBy("building_id", month.alias("month"))
        .agg(F.array_sort(F.collect_list(F.struct("day", "consumption_kwh", "peak_demand_kw", "readings"))).alias("daily"))
    )
    by_severity = severity_breakdown(
        incidents.withColumn("month", F.date_format("timestamp", "yyyy-MM")), "month"
    )
    found = by_severity.groupBy("building_id", "month").agg(
        F.sum("incidents").alias("anomaly_count"),
        F.sum("estimated_waste_vnd").alias("estimated_waste_vnd"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "incidents")))).alias("anomaly_breakdown"),
    )
    empty = F.from_json(F.lit("{}"), "map<string,bigint>")
    return (
        monthly_summary(readings, value)
        .join(days, ["building_id", "month"], "left")
        .join(found, ["building_id", "month"], "left")
        .withColumn("report_id", F.concat_ws("-", "building_id", "month"))
        .withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0)))
        .withColumn("estimated_waste_vnd", F.coalesce("estimated_waste_vnd", F.lit(0.0)))
        .withColumn("anomaly_breakdown", F.coalesce("anomaly_breakdown", empty))
    )


def forecast_summary(forecast: DataFrame) -> DataFrame:
    """Peak of a forecast, when it comes, its band, and the mean."""
    peak = F.min_by(
        F.struct("timestamp", "predicted_kwh", "lower_bound_95", "upper_bound_95"),
        F.struct(-F.col("predicted_kwh"), F.col("timestamp")),
    )
    return (
        forecast.groupBy("building_id")
        .agg(peak.alias("p"), half_up(F.avg("predicted_kwh"), 1).alias("average_forecast_kwh"))
        .select(
            "building_id",
            F.col("p.predicted_kwh").alias("expected_peak_kw"),
            F.col("p.timestamp").alias("peak_timestamp"),
            "average_forecast_kwh",
            half_up(F.col("p.lower_bound_95"), 1).alias("peak_lower"),
            half_up(F.col("p.upper_bound_95"), 1).alias("peak_upper"),
        )
    )


def peak_time(series: DataFrame, value: str = "meter_reading") -> DataFrame:
    """When the highest reading came; the earliest wins a tie, nulls lose."""
    rank = F.struct(F.coalesce(-F.col(value), F.lit(float("inf"))), F.col("timestamp"))
    return series.groupBy("building_id").agg(
        F.min_by("timestamp", rank).alias("peak_timestamp"), F.max(value).alias("peak_kwh")
    )


def hour_profile(series: DataFrame, value: str = "meter_reading") -> DataFrame:
    """Median load for each of the 168 hours of a week, with fallbacks."""
    overall = series.groupBy("building_id").agg(F.median(value).alias("overall"))
    slots = overall.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(167)))).select(
        "building_id", "overall", (F.floor(F.col("slot") / 24)).cast("int").alias("dayofweek"),
        (F.col("slot") % 24).alias("hour"),
    )
    known = series.groupBy(
        "building_id", F.weekday("timestamp").alias("dayofweek"), F.hour("timestamp").alias("hour")
    ).agg(F.median(value).alias("known"))
    return slots.join(known, ["building_id", "dayofweek", "hour"], "left").select(
        "building_id", "dayofweek", "hour",
        half_up(F.coalesce("known", "overall", F.lit(S.DEFAULT_LOAD_KWH)), 4).alias("profile_kwh"),
    )


def sparkline_stats(readings: DataFrame, key: str = "meter_id", value: str = "meter_reading_kwh") -> DataFrame:
    """Mean, minimum and maximum of the last 24 points; a single point gives none."""
    last = rows.newest(readings, [key], [F.col("timestamp").desc(), F.col("id").desc()], 24)
    kwh = F.coalesce(F.col(value), F.lit(0.0))
    return (
        last.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("points"),
            half_up(F.avg(kwh), 4).alias("mean_kwh"), F.min(kwh).alias("min_kwh"), F.max(kwh).alias("max_kwh"),
        )
        .filter(F.col("points") >= 2)
    )


def incident_status_counts(incidents: DataFrame) -> DataFrame:
    status = incidents.withColumn("status", F.coalesce("status", F.lit("OPEN")))
    counts = status.groupBy("building_id").pivot("status", S.STATUSES).count()
    return counts.select(
        "building_id", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in S.STATUSES]
    )


def read_interaction_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines written by the assistant; lines that do not parse are skipped."""
    schema = "intent STRING, latency_ms DOUBLE, tools_called ARRAY<STRING>, is_grounded BOOLEAN"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def interaction_stats(log: DataFrame) -> DataFrame:
    """One row; the two maps hold one entry per intent and per tool."""
    base = log.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.coalesce(half_up(F.avg(F.coalesce("latency_ms", F.lit(0.0))), 2), F.lit(0.0)).alias("average_latency_ms"),
        F.coalesce(half_up(F.avg(F.coalesce("is_grounded", F.lit(False)).cast("double")), 4), F.lit(0.0)).alias(
            "grounded_ratio"
        ),
        F.lit("all").alias("_k"),
    )

    def distribution(names: DataFrame, alias: str) -> DataFrame:
        counted = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy(F.lit("all").alias("_k")).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(alias)
        )

    intents = distribution(log.select(F.coalesce("intent", F.lit("other")).alias("name")), "intents_distribution")
    tools = distribution(log.select(F.explode("tools_called").alias("name")), "tool_usage_counts")
    return base.join(intents, "_k", "left").join(tools, "_k", "left").drop("_k")
