"""Choosing, joining and filling the series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions import settings as S
from wattloom.functions.numeric import half_up
from wattloom.operators import rows


def completeness_rank(readings: DataFrame) -> DataFrame:
    """Buildings by fewest nulls, fewest zeros, widest spread; rank 1 represents."""
    stats = readings.groupBy("building_id").agg(
        F.count_if(F.col("meter_reading").isNull()).alias("null_count"),
        F.count_if(F.col("meter_reading") == 0).alias("zero_count"),
        half_up(F.avg("meter_reading"), 4).alias("mean"),
        half_up(F.stddev_samp("meter_reading"), 4).alias("std"),
    )
    order = [F.col("null_count"), F.col("zero_count"), F.col("std").desc_nulls_last(), F.col("building_id")]
    return rows.global_position(stats, order, "completeness").withColumnRenamed("position", "rank")


def merge_weather(readings: DataFrame, buildings: DataFrame, weather: DataFrame) -> DataFrame:
    """Readings with their site's temperature; no weather leaves a null.

    Both joins are plain equi joins: the dimension is broadcast by its real
    size, the weather join is left to AQE, which splits hot sites.
    """
    sited = readings.join(buildings.select("building_id", "site_id"), "building_id", "left")
    return sited.join(weather, ["site_id", "timestamp"], "left").select(
        *readings.columns, "site_id", "air_temperature"
    )


def null_profile(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Null count per column before and after filling."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        return one.unpivot([], columns, "column", name)

    return counts(before, "nulls_before").join(counts(after, "nulls_after"), "column")


def interpolate_linear(df: DataFrame, columns: list[str], key: str = "building_id", ts: str = "timestamp") -> DataFrame:
    """Straight line between neighbours by row position; ends repeat the nearest value.

    The nearest value ahead is looked up in reversed order, so both windows
    grow by one row at a time. A key holds one row per hour here.
    """
    forward = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(key).orderBy(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_pos", F.row_number().over(Window.partitionBy(key).orderBy(ts)))
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("_pos").alias("p")))
        out = out.withColumn(f"_l_{c}", F.last(known, ignorenulls=True).over(forward))
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("_pos").alias("p")))
        out = out.withColumn(f"_r_{c}", F.last(known, ignorenulls=True).over(backward))
    for c in columns:
        left, right = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        share = (F.col("_pos") - left.p) / (right.p - left.p)
        filled = (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(left.isNull(), right.v)
            .when(right.isNull(), left.v)
            .otherwise(left.v + (right.v - left.v) * share)
        )
        out = out.withColumn(c, half_up(filled, 2))
    return out.select(*df.columns)


def prepare_hourly_live(raw: DataFrame) -> DataFrame:
    """Typed live rows from text: bad numbers are null, rows without time or value go."""
    temperature = (
        F.col("outdoor_temperature_c").try_cast("double")
        if "outdoor_temperature_c" in raw.columns
        else F.lit(None).cast("double")
    )
    keep = [c for c in raw.columns if c not in ("timestamp", "meter_reading_kwh", "outdoor_temperature_c")]
    return raw.select(
        *keep,
        F.col("timestamp").try_cast("timestamp_ntz").alias("timestamp"),
        F.col("meter_reading_kwh").try_cast("double").alias("meter_reading"),
        F.coalesce(temperature, F.lit(S.DEFAULT_TEMPERATURE_C)).alias("air_temperature"),
    ).dropna(subset=["timestamp", "meter_reading"])
