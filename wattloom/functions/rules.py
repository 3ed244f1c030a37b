"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattloom.functions import settings as S
from wattloom.functions.numeric import fixed, half_up


def calendar(ts: Column) -> dict[str, Column]:
    """Calendar features in the order the models expect them."""
    hour = F.hour(ts)
    weekday = F.weekday(ts)
    angle = hour * F.lit(2.0) * F.pi() / F.lit(24.0)
    return {
        "hour": hour,
        "dayofweek": weekday,
        "is_weekend": (weekday >= 5).cast("int"),
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
    }


def temperature_band(celsius: Column) -> Column:
    cold, good, warm, hot = S.TEMPERATURE_LABELS
    return (
        F.when(celsius.isNull() | F.isnan(celsius), S.NO_READING_LABEL)
        .when(celsius < 22, cold).when(celsius <= 25, good).when(celsius <= 28, warm).otherwise(hot)
    )


def load_band(kwh: Column) -> Column:
    low, middle, high = S.LOAD_LABELS
    return (
        F.when(kwh.isNull() | F.isnan(kwh), S.NO_READING_LABEL)
        .when(kwh < 40, low).when(kwh <= 80, middle).otherwise(high)
    )


def surge_ratio(actual: Column, lag_24h: Column) -> Column:
    return F.when(lag_24h > 0, actual / lag_24h).otherwise(F.lit(1.0))


def severity(score: Column, actual: Column, lag_24h: Column) -> Column:
    ratio = surge_ratio(actual, lag_24h)
    return (
        F.when((score >= 0.0) | (ratio >= 3.0), "HIGH")
        .when((score >= -0.03) | (ratio >= 1.8), "MEDIUM")
        .otherwise("LOW")
    )


def advice(level: Column, actual: Column) -> Column:
    reading = fixed(actual, 1)
    text = F.format_string(S.ADVICE["LOW"], reading)
    for name in ("MEDIUM", "HIGH"):
        text = F.when(level == name, F.format_string(S.ADVICE[name], reading)).otherwise(text)
    return text


def waste(delta_kwh: Column, hours: Column) -> dict[str, Column]:
    excess = delta_kwh * hours
    return {
        "excess_kwh": half_up(excess, 1),
        "cost_vnd": half_up(excess * S.TARIFF_VND, 0),
        "cost_usd": half_up(excess * S.TARIFF_USD, 2),
    }


def band(predicted: Column, q_low: Column, q_high: Column, scale=1.0) -> tuple[Column, Column]:
    """The one 95% band: encloses the prediction and never goes below zero."""
    factor = scale if isinstance(scale, Column) else F.lit(scale)
    p, lo, hi = predicted * factor, q_low * factor, q_high * factor
    return F.greatest(F.lit(0.0), F.least(lo, p)), F.greatest(hi, p)


def hourly_rate(kwh: Column, interval_s: Column) -> Column:
    """kWh per hour of a short interval; 0 or absent means one hour."""
    given = F.when(interval_s.isNull() | (interval_s == 0), F.lit(S.DEFAULT_INTERVAL_S)).otherwise(interval_s)
    return F.greatest(F.lit(0.0), kwh * (F.lit(3600.0) / F.greatest(F.lit(1.0), given)))


def meter_key(building: Column, zone: Column) -> Column:
    return F.concat(F.lit("meter-"), F.md5(F.concat(building, F.lit(":"), F.coalesce(zone, F.lit("total")))))


def residual_severity(flag: Column, actual: Column, predicted: Column) -> Column:
    return (
        F.when(~flag, "Normal").when(actual > predicted * 1.30, "Critical").otherwise("Medium")
    )


def zone_share(zone: Column) -> Column:
    """Share of the building's load; a fixed map, so no join is needed."""
    table = F.create_map(*[F.lit(x) for pair in S.ZONE_SHARES.items() for x in pair])
    return F.when(zone.isNull(), F.lit(1.0)).otherwise(
        F.coalesce(F.try_element_at(table, zone), F.lit(S.UNKNOWN_ZONE_SHARE))
    )
