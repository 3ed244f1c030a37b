"""Trained models on the given tables, in full; the twins state what must hold of their outcome."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions import settings as S
from wattloom.functions.numeric import half_up
from wattloom.functions.numeric import sql_round as r
from wattloom.operators import forecast, forest, trees
from wattloom.plans.registry import query
from wattloom.plans.views import Tables
from wattloom.session import cut_lineage

KEYS = forecast.KEYS


class Trained:
    """Split features and the models fitted on their training part, each fitted when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.split = cut_lineage(Tables(spark, folder).split(), "split")
        self.train = self.split.filter(F.col("part") == "train")
        self.test = self.split.filter(F.col("part") == "test")

    @cached_property
    def gbt(self) -> trees.Ensemble:
        return forecast.gbt_forecaster(self.train)

    @cached_property
    def load(self) -> forecast.LoadModel:
        return forecast.load_model(self.train)

    @cached_property
    def forest(self) -> forest.IsolationForest:
        return forest.isolation_forest_fit(self.train, S.DETECTOR_FEATURES, KEYS)


def trained(t: Tables) -> Trained:
    """Fitted anew for each query, so no query rests on an older file or on another's time."""
    return Trained(t.spark, t.folder)


# What a fitted model gives is no value that SQL could compute. These queries fit and apply it in full
# and return, row by row, what must hold of the outcome, which the twins state.


@query("isolation_forest_fit", f"""
SELECT tree, place, feature, {r("threshold", 6)} AS threshold, leaf, {r("path", 6)} AS path FROM v_forest_node""", ("v_forest_node",))
def _(t: Tables) -> DataFrame:
    nodes = trained(t).forest.nodes
    return nodes.select("tree", "place", "feature", half_up(F.col("threshold"), 6).alias("threshold"), (F.col("left") < 0).alias("leaf"), half_up(F.col("path"), 6).alias("path"))


@query("isolation_forest_score", f"""
SELECT building_id, timestamp, label, {r("anomaly_score", 4)} AS anomaly_score, {r("decision", 6)} AS decision FROM v_forest_score""", ("v_forest_score",))
def _(t: Tables) -> DataFrame:
    made = trained(t)
    scored = forest.isolation_forest_score(made.split, made.forest)
    return scored.select("building_id", "timestamp", "label", half_up(F.col("anomaly_score"), 4).alias("anomaly_score"), half_up(F.col("decision"), 6).alias("decision"))


def band_holds() -> Column:
    return (F.col("lower_bound_95") <= F.col("predicted_kwh")) & (F.col("predicted_kwh") <= F.col("upper_bound_95")) & (F.col("lower_bound_95") >= 0)


def scored_facts(scored: DataFrame) -> DataFrame:
    residual = F.col("meter_reading_kwh") - F.col("predicted_kwh")
    return scored.select(
        "building_id", "timestamp", half_up(F.col("meter_reading_kwh"), 2).alias("meter_reading_kwh"),
        (F.abs(residual - F.col("residual")) < 0.011).alias("residual_fits"), band_holds().alias("band_holds"),
        ((F.col("severity") == "Normal") != F.col("is_anomaly")).alias("severity_follows_flag"), F.col("anomaly_score").between(0, 1).alias("score_in_range"),
    )


FACTS = "true AS residual_fits, true AS band_holds, true AS severity_follows_flag, true AS score_in_range"


@query("score_frame", f"SELECT building_id, timestamp, {r('meter_reading', 2)} AS meter_reading_kwh, {FACTS} FROM v_split", ("v_split",))
def _(t: Tables) -> DataFrame:
    made = trained(t)
    return scored_facts(forecast.score_frame(made.split, made.load, made.forest))


@query("gbt_forecaster", "SELECT building_id, count(*) AS rows, true AS beats_seasonal_naive FROM v_split WHERE part = 'test' GROUP BY 1", ("v_split",))
def _(t: Tables) -> DataFrame:
    made = trained(t)
    scored = forecast.gbt_predict(made.gbt, made.test)
    error = lambda c: F.avg(F.abs(F.col("meter_reading") - F.col(c)))
    return scored.groupBy("building_id").agg(F.count("*").alias("rows"), (error("prediction") < error("lag_24h")).alias("beats_seasonal_naive"))


@query(
    "quantile_forecaster",
    "SELECT building_id, count(*) AS rows, true AS covers, true AS low_below_high FROM v_split WHERE part = 'test' GROUP BY 1",
    ("v_split",),
)
def _(t: Tables) -> DataFrame:
    made = trained(t)
    scored = forecast.load_predict(made.test, made.load)
    inside = F.col("meter_reading").between(F.col("q_low"), F.col("q_high")).cast("double")
    return scored.groupBy("building_id").agg(
        F.count("*").alias("rows"), (F.avg(inside) >= 0.75).alias("covers"), (F.avg("q_low") < F.avg("q_high")).alias("low_below_high")
    )


NEXT_DAY = "SELECT building_id, timestamp + INTERVAL 24 HOUR AS timestamp, true AS band_holds FROM v_clean WHERE timestamp > (SELECT max(timestamp) FROM v_clean) - INTERVAL 24 HOUR"


@query("recursive_forecast", NEXT_DAY, ("v_clean",))
def _(t: Tables) -> DataFrame:
    made = trained(t)
    return forecast.recursive_forecast(made.split, made.load).select("building_id", "timestamp", band_holds().alias("band_holds"))


def tripled(split: DataFrame) -> DataFrame:
    """The series with one building at three times its level, so that scales differ."""
    return split.select(
        "building_id", "timestamp", "air_temperature",
        F.when(F.col("building_id") == "b1", F.col("meter_reading") * 3).otherwise(F.col("meter_reading")).alias("meter_reading"),
    )


@query("live_scale", "SELECT DISTINCT building_id, true AS within_limits, building_id = 'b1' AS raised FROM v_split", ("v_split",))
def _(t: Tables) -> DataFrame:
    made = trained(t)
    scale = forecast.live_scale(tripled(made.split), made.load)
    return scale.select("building_id", F.col("scale").between(0.05, 5.0).alias("within_limits"), (F.col("scale") > 1.5).alias("raised"))


@query("anchored_forecast", NEXT_DAY, ("v_clean",))
def _(t: Tables) -> DataFrame:
    made = trained(t)
    return forecast.anchored_forecast(tripled(made.split), made.load).select("building_id", "timestamp", band_holds().alias("band_holds"))


@query(
    "score_live_series",
    f"""SELECT building_id, timestamp, {r("CASE WHEN building_id = 'b1' THEN 3 * meter_reading ELSE meter_reading END", 2)} AS meter_reading_kwh, {FACTS}
FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY timestamp DESC) AS newest FROM v_split) q WHERE newest <= 168""",
    ("v_split",),
)
def _(t: Tables) -> DataFrame:
    made = trained(t)
    return scored_facts(forecast.score_live_series(tripled(made.split), made.load, made.forest))


ARX_VALUE = "w.w0 + w.w1 * lag_1h + w.w2 * lag_24h + w.w3 * air_temperature"


@query("seasonal_arx", f"""
SELECT t.building_id, t.timestamp, t.meter_reading, {r(ARX_VALUE, 2)} AS prediction FROM v_split t JOIN v_arx w ON w.building_id = t.building_id WHERE t.part = 'test'""", ("v_split", "v_arx"))
def _(t: Tables) -> DataFrame:
    made = trained(t)
    predicted = forecast.arx_predict(made.test, forecast.arx_fit(made.train))
    return predicted.select("building_id", "timestamp", "meter_reading", half_up(F.col("prediction"), 2).alias("prediction"))


@query(
    "model_leaderboard",
    "SELECT model, (SELECT count(*) FROM v_split WHERE part = 'train') AS train_rows, true AS errors_ordered, model <> 'seasonal_naive' AS has_size FROM (VALUES ('seasonal_naive'), ('seasonal_arx'), ('gbt'), ('gbt_median')) m(model)",
    ("v_split",),
)
def _(t: Tables) -> DataFrame:
    board = forecast.model_leaderboard(trained(t).split, forecast.standard_forecasters())
    return board.select("model", "train_rows", (F.col("mae") <= F.col("rmse")).alias("errors_ordered"), (F.col("size_bytes") > 0).alias("has_size"))


CANDIDATES = [{"rounds": rounds, "depth": depth, "rate": rate} for rounds, rate in ((350, 0.05), (175, 0.1)) for depth in (3, 4)]


@query("grid_search", f"SELECT CAST({len(CANDIDATES)} AS BIGINT) AS candidates, CAST(3 AS BIGINT) AS folds, true AS best_is_least")
def _(t: Tables) -> DataFrame:
    found = forecast.grid_search(trained(t).train, CANDIDATES)
    least = F.min(F.when(~F.col("pruned"), F.col("mean_rmse"))) == F.min(F.when(F.col("is_best"), F.col("mean_rmse")))
    return found.agg(F.count("*").alias("candidates"), F.max("folds").alias("folds"), (least & (F.count_if("is_best") == 1)).alias("best_is_least"))
