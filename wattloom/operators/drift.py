"""Distribution drift and what it triggers.

Samples are compared per building and column on the hourly series, so a
group holds at most one value per hour of its window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions import settings as S
from wattloom.functions.numeric import half_up

KEYS = ["building_id", "column"]


def samples(reference: DataFrame, recent: DataFrame, columns: list[str]) -> DataFrame:
    """Long form of both windows: building, column, value, is_reference."""

    def long(df: DataFrame, flag: bool) -> DataFrame:
        return (
            df.unpivot("building_id", columns, "column", "value")
            .filter(F.col("value").isNotNull())
            .withColumn("is_reference", F.lit(flag))
        )

    return long(reference, True).unionByName(long(recent, False))


def psi(both: DataFrame) -> DataFrame:
    """Population stability index over bins of reference quantiles.

    Tied quantiles fall back to equal widths. A bin is the number of inner
    edges at or below the value; all bins are counted in one aggregate.
    """
    bins = S.PSI_BINS
    value = F.when(F.col("is_reference"), F.col("value"))
    shape = both.groupBy(*KEYS).agg(
        F.percentile(value, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("_q"),
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_nr"),
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    equal = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("_lo") + width * i)
    edges = F.when(F.size(F.array_distinct("_q")) < bins + 1, equal).otherwise(F.col("_q"))
    inner = shape.withColumn("_e", F.slice(edges, 2, bins - 1))
    binned = both.join(inner, KEYS).withColumn(
        "_b", F.size(F.filter("_e", lambda e: e <= F.col("value")))
    )
    counts = binned.groupBy(*KEYS).agg(
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_nr").alias("_nr"),
        F.count_if(~F.col("is_reference")).alias("_nn"),
        *[F.expr(f"count_if(is_reference AND _b = {i}) AS _r{i}") for i in range(bins)],
        *[F.expr(f"count_if(NOT is_reference AND _b = {i}) AS _n{i}") for i in range(bins)],
    )
    shares = [f"struct(_r{i} / _nr + {S.PSI_EPSILON}D AS r, _n{i} / _nn + {S.PSI_EPSILON}D AS n)" for i in range(bins)]
    total = F.expr(f"aggregate(array({', '.join(shares)}), 0D, (a, s) -> a + (s.n - s.r) * ln(s.n / s.r))")
    defined = (F.col("_nr") > 0) & (F.col("_nn") > 0) & (F.col("_lo") != F.col("_hi"))
    return counts.select(*KEYS, half_up(F.when(defined, total).otherwise(F.lit(0.0)), 6).alias("psi"))


def smirnov_tail(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value; 1 where the series has not started to fall."""
    lam = F.sqrt(n * m / (n + m)) * statistic
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(k * k * lam * lam * -2.0),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ks_two_sample(both: DataFrame) -> DataFrame:
    """Largest gap of the two distribution functions and its p-value.

    Equal values are counted first, so the running sums see each distinct
    value once.
    """
    reference = F.col("is_reference")
    by_value = both.groupBy(*KEYS, "value").agg(
        F.count_if(reference).alias("r"), F.count_if(~reference).alias("n")
    )
    whole = Window.partitionBy(*KEYS)
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    gaps = (
        by_value.withColumns({"_cr": F.sum("r").over(upto), "_cn": F.sum("n").over(upto)})
        .withColumns({"_tr": F.sum("r").over(whole), "_tn": F.sum("n").over(whole)})
        .groupBy(*KEYS)
        .agg(
            F.max("_tr").alias("ref_n"), F.max("_tn").alias("rec_n"),
            F.max(F.abs(F.try_divide("_cr", "_tr") - F.try_divide("_cn", "_tn"))).alias("_d"),
        )
        .withColumn("insufficient_data", (F.col("ref_n") == 0) | (F.col("rec_n") == 0))
    )
    p = smirnov_tail(F.col("_d"), F.col("ref_n"), F.col("rec_n"))
    empty = F.col("insufficient_data")
    return gaps.select(
        *KEYS,
        half_up(F.when(empty, F.lit(0.0)).otherwise(F.col("_d")), 6).alias("ks_statistic"),
        half_up(F.when(empty, F.lit(1.0)).otherwise(p), 6).alias("p_value"),
        "ref_n", "rec_n", "insufficient_data",
    )


def drift_check(reference: DataFrame, recent: DataFrame, rolling: DataFrame, columns: list[str]) -> DataFrame:
    """One row per building: signals per column, rolling MAPE and what was triggered.

    ``rolling`` holds building_id and mape_percent (null when no model could score).
    """
    both = samples(reference, recent, columns)
    signals = ks_two_sample(both).join(psi(both), KEYS)
    wide = signals.groupBy("building_id").agg(
        *[
            F.max(F.when(F.col("column") == c, F.struct("ks_statistic", "p_value", "psi", "ref_n", "rec_n", "insufficient_data"))).alias(c)
            for c in columns
        ]
    )
    hits = [
        F.when((F.col(f"{c}.p_value") < S.KS_PVALUE_LIMIT) & (F.col(f"{c}.psi") > S.PSI_LIMIT), F.lit(c))
        for c in columns
    ]
    late = F.when(F.col("mape_percent") > S.MAPE_LIMIT, F.lit("rolling_mape"))
    return (
        wide.join(rolling, "building_id", "left")
        .withColumn("triggered_signals", F.array_compact(F.array(*hits, late)))
        .withColumn("drift_detected", F.size("triggered_signals") > 0)
        .withColumn(
            "thresholds",
            F.struct(F.lit(S.KS_PVALUE_LIMIT).alias("ks_pvalue"), F.lit(S.PSI_LIMIT).alias("psi"), F.lit(S.MAPE_LIMIT).alias("mape_percent")),
        )
    )


def retrain_trigger(drift: DataFrame, running: DataFrame) -> DataFrame:
    """Decision per drift row; ``running`` lists buildings with an active run."""
    only_mape = F.col("triggered_signals") == F.array(F.lit("rolling_mape"))
    busy = F.col("_busy").isNotNull()
    return (
        drift.join(running.select("building_id", F.lit(True).alias("_busy")), "building_id", "left")
        .withColumn("retrain_triggered", F.col("drift_detected") & ~busy)
        .withColumn(
            "retrain_trigger",
            F.when(F.col("retrain_triggered"), F.when(only_mape, "mape").otherwise("drift")),
        )
        .withColumn("retrain_skipped_reason", F.when(F.col("drift_detected") & busy, "retrain_already_running"))
        .drop("_busy")
    )


def model_status(sections: DataFrame, runs: DataFrame, newest: int = 50) -> DataFrame:
    """One row on the state of the models.

    ``sections``: section, payload (JSON text), error (null when it parsed).
    A missing section is null; a bad one is reported in ``errors`` and leaves
    the others alone. Of ``runs`` the ``newest`` are nested, newest first; those without a readable time
    come last.
    """
    names = ["champion", "drift", "anomaly_quality", "benchmark"]
    good = F.col("error").isNull()
    state = sections.groupBy(F.lit(1).alias("_k")).agg(
        *[F.max(F.when((F.col("section") == n) & good, F.col("payload"))).alias(n) for n in names],
        *[F.max(F.when(F.col("section") == n, F.col("error"))).alias(f"_e_{n}") for n in names],
    )
    errors = F.map_filter(
        F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"_e_{n}"))]), lambda _k, v: v.isNotNull()
    )
    at = F.try_to_timestamp(F.col("timestamp"))
    last = runs.withColumn("_at", at).orderBy(F.desc_nulls_last("_at"), *[F.desc_nulls_last(c) for c in runs.columns]).limit(newest)
    listed = last.groupBy(F.lit(1).alias("_k")).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), *runs.columns)))).alias("retrain_history")
    )
    return state.withColumn("errors", errors).join(listed, "_k", "left").select(*names, "retrain_history", "errors")
