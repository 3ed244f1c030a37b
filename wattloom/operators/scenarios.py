"""Savings of setpoint and early-off scenarios on a forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions import settings as S
from wattloom.functions.numeric import half_up

UTC_OFFSET_H = 7
COOLING_FROM = 7
COOLING_TO = 18
RATE_LOW = 0.06
RATE_HIGH = 0.08


def scenario_validate(scenarios: DataFrame) -> DataFrame:
    """Adds ``reason``; a null reason means the scenario may be simulated."""
    delta, hours, share = F.col("setpoint_delta_c"), F.col("off_hours"), F.col("hvac_share")
    return scenarios.withColumn(
        "reason",
        F.when(delta.isNull() | ~delta.between(0, 2) | ((delta * 2) % 1 != 0), "setpoint_delta_c")
        .when(hours.isNull() | ~hours.between(0, 3) | (hours % 1 != 0), "off_hours")
        .when(share.isNull() | ~share.between(0.05, 0.8), "hvac_share"),
    )


def scenario_savings_hourly(forecast: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Saving per forecast hour and scenario of the hour's building.

    ``scenarios``: scenario, building_id, setpoint_delta_c, off_hours, hvac_share. Those that
    :func:`scenario_validate` gives a reason are left out, so a forecast meets accepted ones only. A
    building's forecast is some hours, its scenarios may be many: the join is on the building, and hot
    buildings are split by the planner.
    """
    accepted = scenario_validate(scenarios).filter(F.col("reason").isNull()).drop("reason")
    local = (F.hour("timestamp") + UTC_OFFSET_H) % 24
    cooling = (F.col("local_hour") >= COOLING_FROM) & (F.col("local_hour") < COOLING_TO)
    early = cooling & (F.col("local_hour") >= COOLING_TO - F.col("off_hours"))
    hvac = F.col("predicted_kwh") * F.col("hvac_share")

    def saving(rate: float):
        return (
            F.when(early, hvac)
            .when(cooling, hvac * F.col("setpoint_delta_c") * rate)
            .otherwise(F.lit(0.0))
        )

    return (
        accepted.join(forecast.select("building_id", "timestamp", "predicted_kwh"), "building_id")
        .withColumn("local_hour", local)
        .withColumn("is_cooling", cooling)
        .withColumn("saving_low_kwh", saving(RATE_LOW))
        .withColumn("saving_high_kwh", saving(RATE_HIGH))
        .withColumn("scenario_low_kwh", half_up(F.col("predicted_kwh") - F.col("saving_high_kwh"), 2))
        .withColumn("scenario_high_kwh", half_up(F.col("predicted_kwh") - F.col("saving_low_kwh"), 2))
    )


def scenario_savings_total(hourly: DataFrame) -> DataFrame:
    """Baseline and savings as energy, money and CO2 per building and scenario."""
    sums = hourly.groupBy("building_id", "scenario").agg(
        F.sum("predicted_kwh").alias("baseline"), F.sum("saving_low_kwh").alias("low"),
        F.sum("saving_high_kwh").alias("high"), F.count_if("is_cooling").alias("cooling_hours"),
    )
    columns = []
    for name in ("baseline", "low", "high"):
        columns += [
            half_up(F.col(name), 2).alias(f"{name}_kwh"),
            half_up(F.col(name) * S.TARIFF_VND, 0).alias(f"{name}_vnd"),
            half_up(F.col(name) * S.KG_CO2_PER_KWH, 2).alias(f"{name}_co2_kg"),
        ]
    note = F.when(F.col("cooling_hours") == 0, F.lit(S.NO_COOLING_NOTE))
    return sums.select("building_id", "scenario", *columns, note.alias("note"))
