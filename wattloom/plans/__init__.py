"""Registered queries: each operator on the given tables, with its SQL twin."""

from __future__ import annotations

import importlib

from wattloom.plans import registry

MODULES = ["q_sources", "q_aggregates", "q_series", "q_relations", "q_incidents", "q_evaluation", "q_text", "q_streams", "q_models"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"wattloom.plans.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLE)


def flagship(spark, folder: str):
    """Daily consumption per building, next to the error of its seasonal-naive forecast."""
    from pyspark.sql import functions as F

    from wattloom.operators import aggregates, evaluation
    from wattloom.plans.views import Tables

    tables = Tables(spark, folder)
    daily = aggregates.daily_breakdown(tables.hourly())
    naive = evaluation.seasonal_naive(tables.clean()).withColumn("actual", F.col("meter_reading"))
    error = evaluation.forecast_metrics(naive, "building_id").select("building_id", "mae", "rmse", "mape", "r2")
    return daily.join(error, "building_id").orderBy("building_id", "day")
