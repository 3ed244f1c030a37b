"""File scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from wattloom.functions import settings as S
from wattloom.operators import rows

TELEMETRY_SCHEMA = "building_id STRING, timestamp TIMESTAMP_NTZ, meter_reading DOUBLE, air_temperature DOUBLE"
RESULT_SCHEMA = "model STRING, mae DOUBLE, rmse DOUBLE, mape DOUBLE, r2 DOUBLE"
HORIZON_SCHEMA = "model STRING, horizon_h INT, mae DOUBLE, rmse DOUBLE"


def _first_present(columns: list[str], wanted: list[str], what: str) -> str:
    for name in wanted:
        if name in columns:
            return name
    raise KeyError(f"no {what} column: expected one of {wanted}")


def scan_meter_metadata(spark: SparkSession, path: str, use: str = "office") -> DataFrame:
    """Buildings of one use from a metadata CSV."""
    raw = spark.read.option("header", True).csv(path)
    use_column = _first_present(raw.columns, S.USE_ALIASES, "primary use")
    optional = [
        (F.col(c).cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c)
        for c, t in (("sqm", "double"), ("timezone", "string"))
    ]
    return raw.filter(F.lower(F.col(use_column)) == use).select(
        "building_id", F.col("site_id").cast("int").alias("site_id"),
        F.col(use_column).alias("primary_use"), *optional,
    )


def unpivot_meters(wide: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per building and hour from one column per building.

    Only columns that the metadata names are read and unpivoted; metadata without a column has nothing
    to contribute.
    """
    meters = [c for c in wide.columns if c != "timestamp"]
    # at most one row per column
    named = {r[0] for r in metadata.filter(F.col("building_id").isin(meters)).select("building_id").distinct().collect()}
    chosen = [c for c in meters if c in named]
    if not chosen:
        return wide.select(F.lit("").alias("building_id"), "timestamp", F.lit(None).cast("double").alias("meter_reading")).filter(F.lit(False))
    return wide.select("timestamp", *[F.col(f"`{c}`") for c in chosen]).unpivot("timestamp", [F.col(f"`{c}`") for c in chosen], "building_id", "meter_reading").select("building_id", "timestamp", "meter_reading")


def scan_site_weather(weather: DataFrame, sequence: list[str], site: int | None = None) -> DataFrame:
    """One temperature per site and time; ``sequence`` is the order of the file."""
    column = _first_present(weather.columns, S.WEATHER_ALIASES, "air temperature")
    chosen = weather if site is None else weather.filter(F.col("site_id") == site)
    kept = rows.first_per_key(chosen, ["site_id", "timestamp"], [F.col(c) for c in sequence])
    return kept.select("site_id", "timestamp", F.col(column).alias("air_temperature"))


def scan_telemetry(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Typed telemetry; Spark raises for a missing path, reported as a missing file."""
    try:
        if fmt == "csv":
            return (
                spark.read.schema(TELEMETRY_SCHEMA)
                .option("header", True)
                .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
                .csv(path)
            )
        return spark.read.schema(TELEMETRY_SCHEMA).parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(path) from error


def standardise_columns(df: DataFrame) -> DataFrame:
    """Renames known aliases unless the standard column is already there."""
    present = set(df.columns)
    renames = {}
    for target, aliases in (("meter_reading", S.READING_ALIASES), ("air_temperature", S.TEMPERATURE_ALIASES)):
        if target in present:
            continue
        match = next((a for a in aliases if a in present), None)
        if match:
            renames[match] = target
    return df.withColumnsRenamed(renames)


#: Constants that JSON doesn't have.
NON_FINITE = r"(?<![A-Za-z0-9_])(?:NaN|-?Infinity)(?![A-Za-z0-9_])"


def strict_json_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parses JSON objects; a bad row keeps its place with ``error`` set.

    ``schema`` lists the fields wanted. Non-finite constants anywhere outside a
    string, text after the object, repeated keys and other top-level types are
    errors; a null stays null without one.
    """
    fields = [f.name for f in T.StructType.fromDDL(schema).fields]
    text = F.trim(F.col(column))
    parsed = F.from_json(text, schema)
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', '""')
    non_finite = bare.rlike(NON_FINITE)
    # between brackets the parser must read to the end, and one value means nothing came after it
    read = F.when(non_finite, F.regexp_replace(text, NON_FINITE, "0")).otherwise(text)
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), read, F.lit("]"))), "$", "array<variant>")
    error = (
        F.when(F.col(column).isNull(), F.lit(None).cast("string"))
        .when(F.coalesce(F.size(values), F.lit(0)) != 1, F.lit("invalid_json"))
        .when(~text.startswith("{"), F.lit("wrong_type"))
        .when(non_finite, F.lit("non_finite"))
    )
    out = df.withColumn("_p", parsed).withColumn("error", error)
    for name in fields:
        out = out.withColumn(name, F.when(F.col("error").isNull(), F.col(f"_p.{name}")))
    return out.drop("_p")


def export_daily_csv(daily: DataFrame, path: str) -> None:
    """The daily report as a quoted CSV with its fixed header."""
    names = dict(zip(["day", "consumption_kwh", "peak_demand_kw", "readings"], S.DAILY_HEADER))
    daily.withColumnsRenamed(names).write.option("header", True).option("quoteAll", True).option("escape", '"').option(
        "encoding", "UTF-8"
    ).csv(path)


def read_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').csv(path)


def export_incidents_csv(incidents: DataFrame, path: str) -> None:
    """Incident list; cells are quoted only where they need it."""
    incidents.write.option("header", True).option("escape", '"').csv(path)


def write_predictions(predictions: DataFrame, results: DataFrame, by_horizon: DataFrame, path: str) -> None:
    """Long predictions by model as parquet, and the two metric tables as CSV."""
    predictions.write.partitionBy("model").parquet(f"{path}/predictions")
    results.write.option("header", True).csv(f"{path}/results")
    by_horizon.write.option("header", True).csv(f"{path}/by_horizon")


def load_forecast_artifacts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(results, by_horizon, predictions)``; each of the three must exist."""
    out = []
    for name in ("results", "by_horizon", "predictions"):
        part = f"{path}/{name}"
        try:
            if name == "predictions":
                out.append(spark.read.parquet(part))
            else:
                schema = RESULT_SCHEMA if name == "results" else HORIZON_SCHEMA
                out.append(spark.read.schema(schema).option("header", True).csv(part))
        except AnalysisException as error:
            raise FileNotFoundError(part) from error
    return tuple(out)
