"""Ordering helpers that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.numeric import micros

# Spark prunes `row_number() <= n` on the map side up to this n
# (spark.sql.optimizer.windowGroupLimitThreshold).
MAP_SIDE_LIMIT = 1000

# A time bucket of one key with more rows than this is split further.
HOT_BUCKET_ROWS = 1_000_000


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each key in ``order``.

    Up to ``MAP_SIDE_LIMIT`` every map task already drops all but its own ``n``
    best rows per key, so a hot key ships few rows. Beyond it a salted round
    does the same over ``salts`` parts of each key. ``order`` must be total.
    """
    if n > MAP_SIDE_LIMIT:
        spread = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = spread.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= n).drop("_n", "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= n).drop("_n")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return newest(df, keys, order, 1)


def with_history(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, carry: Sequence[str], n: int, unit: str = "day"
) -> tuple[DataFrame, list[str]]:
    """Split each key's rows into time buckets that can be windowed apart.

    Every bucket is given copies of the ``n`` rows before it (``_copy`` is
    true), so a frame of up to ``n`` preceding rows, partitioned by the
    returned columns, sees exactly what it would see over the whole key.
    A key with a third of all rows is then spread over its buckets. Copies
    hold the ``carry`` columns, others are null, so little is shuffled twice.

    Each non-empty bucket holds a row at least, so the ``n`` buckets before
    one always contain its ``n`` previous rows, or all there are. A bucket
    above ``HOT_BUCKET_ROWS`` is cut into equal stretches of its own time.
    """
    keys, carry = list(keys), list(carry)
    bucketed = df.withColumn("_bucket", F.date_trunc(unit, F.col(ts)))
    at = micros(F.col(ts))
    hot = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_c"), F.min(at).alias("_a"), F.max(at).alias("_z"))
        .filter(F.col("_c") > HOT_BUCKET_ROWS)
    )
    own = bucketed.join(hot, keys + ["_bucket"], "left")
    stretch = (F.col("_z") - F.col("_a") + 1) / F.ceil(F.col("_c") / HOT_BUCKET_ROWS)
    own = own.withColumn(
        "_bucket", F.struct("_bucket", F.coalesce(F.floor((at - F.col("_a")) / stretch), F.lit(0).cast("long")).alias("part"))
    ).drop("_c", "_a", "_z")
    narrow = own.select(*keys, "_bucket", ts, tie, *carry)
    tails = newest(narrow, keys + ["_bucket"], [F.col(ts).desc(), F.col(tie).desc()], n)
    per_bucket = tails.groupBy(*keys, "_bucket").agg(
        F.array_sort(F.collect_list(F.struct(ts, tie, *carry))).alias("_tail")
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(-n, -1)
    copies = (
        per_bucket.withColumn("_past", F.flatten(F.collect_list("_tail").over(before)))
        .withColumn("_past", F.slice("_past", F.greatest(F.size("_past") - n + 1, F.lit(1)), n))
        .select(*keys, "_bucket", F.explode("_past").alias("_row"))
        .select(*keys, "_bucket", "_row.*", F.lit(True).alias("_copy"))
    )
    return own.withColumn("_copy", F.lit(False)).unionByName(copies, allowMissingColumns=True), keys + ["_bucket"]


def global_position(df: DataFrame, order: Sequence[Column], label: str, parts: int | None = None) -> DataFrame:
    """Adds ``position``, the 1-based place in a total order over the whole table.

    Range-partitions the rows, writes them once so that the split cannot
    change, and adds to each part the row count of the parts before it: no
    task ever sorts the whole table.
    """
    from wattloom.session import cut_lineage

    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), label
    )
    # one row per part, so the window is over `parts` rows at most, and so is the broadcast
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn("_rn", F.row_number().over(within))
        .join(F.broadcast(offsets), "_part")
        .withColumn("position", F.col("_offset") + F.col("_rn"))
        .drop("_part", "_rn", "_offset")
    )
