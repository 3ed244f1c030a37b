"""Names, functions and SQL twins of all registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.plans.views import Tables, cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, whatever width an expression had."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(
        *[F.col(f"`{f.name}`").cast("long") if isinstance(f.dataType, small) else F.col(f"`{f.name}`") for f in df.schema]
    )


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers ``build(tables) -> DataFrame`` with an optional twin over ``views``."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: plain(build(Tables(spark, folder)))
        if sql is not None:
            ORACLE[name] = cte(*views) + sql.strip()
        return build

    return register
