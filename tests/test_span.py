"""Readings of two years: nothing outside one month is lost, in queries and twins alike."""

import os

import duckdb
import pytest

from tests.compare import connect, difference
from wattloom import plans
from wattloom.plans.views import BASE, Tables


@pytest.fixture(scope="module")
def two_years(folder, tmp_path_factory):
    where = tmp_path_factory.mktemp("years")
    for name in BASE:
        if name != "events":
            os.symlink(f"{folder}/{name}.parquet", where / f"{name}.parquet")
    moved = "SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 380 DAY ELSE ts END AS ts)"
    duckdb.sql(f"COPY ({moved} FROM '{folder}/events.parquet') TO '{where}/events.parquet' (FORMAT parquet)")
    return str(where)


@pytest.mark.parametrize("name", ["hourly_building_series", "lag_features", "live_energy_metrics", "serving_window", "forecast_features", "temperature_proxy", "champion_gate", "pinball_coverage"])
def test_two_years_in_query_and_twin(spark, two_years, name):
    assert difference(plans.queries()[name](spark, two_years), connect(two_years), plans.oracle_sql()[name]) == ""


def test_both_years_are_in_the_series(spark, two_years):
    years = {r[0] for r in Tables(spark, two_years).series().selectExpr("year(timestamp)").distinct().collect()}
    assert years == {2024, 2025}
    assert Tables(spark, two_years).clean().count() == 4 * 24 * 410
