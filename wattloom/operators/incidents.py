"""From anomalous rows to incidents and their life."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions import rules
from wattloom.functions import settings as S
from wattloom.functions.numeric import elapsed, fixed, half_up, micros
from wattloom.operators import rows
from wattloom.session import cut_lineage

HISTORY_TYPE = "array<struct<previous_status:string,status:string,note:string,updated_at:string,actor:string>>"
EVENT_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def residual_severity(scored: DataFrame) -> DataFrame:
    return scored.withColumn(
        "severity", rules.residual_severity(F.col("is_anomaly"), F.col("meter_reading_kwh"), F.col("predicted_kwh"))
    )


def anomaly_events(scored: DataFrame) -> DataFrame:
    """Anomalous rows as incidents with a stable id and their cost.

    The id hashes numbers with four fixed decimals: text that does not depend
    on how an engine prints a double.
    """
    at = F.date_format("timestamp", EVENT_TIME)
    key = F.format_string(
        S.REPLAY_KEY, "building_id", at, fixed(F.col("meter_reading_kwh"), 4), fixed(F.col("predicted_kwh"), 4)
    )
    delta = F.greatest(F.lit(0.0), F.col("meter_reading_kwh") - F.col("predicted_kwh"))
    return scored.filter("is_anomaly").select(
        F.concat(F.lit("ANOM-"), F.substring(F.sha2(key, 256), 1, 40)).alias("id"),
        "building_id", at.alias("timestamp"),
        F.lit(S.REPLAY_SUBSYSTEM).alias("subsystem"),
        "severity", "anomaly_score",
        F.col("meter_reading_kwh").alias("actual_kwh"), "predicted_kwh",
        half_up(delta, 6).alias("delta_kwh"),
        F.col("outdoor_temperature_c").alias("outdoor_temp_c"),
        half_up(delta * S.TARIFF_VND, 0).alias("estimated_waste_vnd"),
        half_up(delta * S.TARIFF_USD, 2).alias("estimated_waste_usd"),
        F.lit("OPEN").alias("status"),
        F.lit(S.REPLAY_REASON).alias("description"),
        F.lit(S.REPLAY_ACTION).alias("suggested_action"),
    )


def array_median(values: Column) -> Column:
    """Median of a short array; null when empty."""
    ordered, n = F.array_sort(values), F.size(values)
    middle = F.floor((n + 1) / 2).cast("int")
    upper = F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.get(ordered, middle - 1) + F.get(ordered, upper - 1)) / 2)


def live_scoring(items: DataFrame, profile: DataFrame) -> DataFrame:
    """Fresh readings that run far above what their meter should draw.

    ``items`` carry ``model_load`` (the load model's value, used when 24
    hourly values exist), ``hours_known``, ``forest_flag`` and
    ``forest_score``; ``profile`` holds the hour profile.
    """
    joined = (
        items.withColumn("dayofweek", F.weekday("timestamp")).withColumn("hour", F.hour("timestamp"))
        .join(profile, ["building_id", "dayofweek", "hour"], "left")
    )
    expected_building = F.when(
        F.col("hours_known") >= 24, F.greatest(F.lit(10.0), F.col("model_load"))
    ).otherwise(F.coalesce("profile_kwh", F.lit(S.DEFAULT_LOAD_KWH)))
    usable = F.filter("recent_meter_hourly_kwhs", lambda v: (v > 0) & (v < float("inf")))
    expected = F.greatest(
        F.lit(0.05),
        F.when(F.size("_usable") >= 3, array_median(F.col("_usable"))).otherwise(
            F.col("expected_building_kwh") * rules.zone_share(F.col("zone_id"))
        ),
    )
    forest = F.col("forest_flag") & (F.col("ratio") >= 1.25)
    level = F.when((F.col("ratio") >= 2.0) | (forest & (F.col("ratio") >= 1.5)), "CRITICAL").otherwise("MEDIUM")
    floor = F.when(F.col("severity") == "CRITICAL", F.lit(0.72)).otherwise(F.lit(0.55))
    place = F.when(F.col("zone_id").isNull(), F.lit(S.BUILDING_TITLE)).otherwise(
        F.concat(F.lit(S.ZONE_TITLE), F.col("zone_id"))
    )
    delta = F.greatest(F.lit(0.0), F.col("_kwh") - F.col("_expected"))
    return (
        joined.withColumn("expected_building_kwh", expected_building)
        .withColumn("_usable", usable)
        .withColumn("_expected", expected)
        .withColumn("_kwh", rules.hourly_rate(F.col("meter_reading_kwh"), F.col("interval_seconds")))
        .withColumn("ratio", F.col("_kwh") / F.col("_expected"))
        .filter(forest | (F.col("ratio") >= 1.6))
        .withColumn("severity", level)
        .withColumn("place", place)
        .select(
            "id", "building_id", "zone_id", "meter_id", "timestamp", "severity",
            F.concat(F.col("place"), F.lit(" (Live)")).alias("subsystem"),
            half_up(F.greatest(F.col("forest_score"), floor), 4).alias("anomaly_score"),
            half_up(F.col("_kwh"), 3).alias("actual_kwh"),
            half_up(F.col("_expected"), 3).alias("predicted_kwh"),
            half_up(delta, 3).alias("delta_kwh"),
            half_up(F.coalesce("outdoor_temperature_c", F.lit(S.DEFAULT_TEMPERATURE_C)), 1).alias("outdoor_temp_c"),
            half_up(delta * S.TARIFF_VND, 0).alias("estimated_waste_vnd"),
            half_up(delta * S.TARIFF_USD, 2).alias("estimated_waste_usd"),
            F.format_string("Live load spike (%sx expected rate) at %s", fixed(F.col("ratio"), 2), "place").alias(
                "description"
            ),
            F.format_string("Inspect HVAC and equipment draw in %s.", "place").alias("suggested_action"),
        )
    )


def live_gate(readings: DataFrame, batch: str, now: str, most: int = 20, minutes: int = 15) -> DataFrame:
    """Readings of small batches that are close to ``now``; the rest is only stored."""
    small = readings.groupBy(batch).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") <= most).select(batch)
    at = F.lit(now).cast("timestamp_ntz")
    near = F.abs(elapsed(F.col("timestamp"), at)) <= minutes * 60
    return readings.filter(near).join(small, batch, "left_semi")


def surge_detector(readings: DataFrame, key: str = "building_id", history: int = 24, threshold: float = 0.0) -> DataFrame:
    """Readings that trip the forest, the score threshold or the 2.5-fold surge rule.

    Nothing is judged before ``history`` readings exist. Needs ``forest_label``
    (-1 or 1) and ``anomaly_score``.
    """
    spread, keys = rows.with_history(readings, [key], "timestamp", "id", ["meter_reading_kwh"], history)
    order = Window.partitionBy(*keys).orderBy("timestamp", "id")
    back = F.lag(F.struct("id", "meter_reading_kwh"), history).over(order)
    ratio = rules.surge_ratio(F.col("meter_reading_kwh"), F.col("lag_24h"))
    return (
        spread.withColumn("_back", back)
        .filter(~F.col("_copy") & F.col("_back").isNotNull())
        .withColumn("lag_24h", F.col("_back.meter_reading_kwh"))
        .withColumn("surge_ratio", ratio)
        .filter(
            (F.col("forest_label") == -1) | (F.col("anomaly_score") >= threshold) | (F.col("surge_ratio") >= 2.5)
        )
        .select(
            "id", key, "timestamp",
            half_up(F.col("meter_reading_kwh"), 2).alias("actual_reading"),
            half_up(F.col("anomaly_score"), 4).alias("anomaly_score"),
            rules.severity(F.col("anomaly_score"), F.col("meter_reading_kwh"), F.col("lag_24h")).alias("severity"),
        )
        .withColumn("suggested_action", rules.advice(F.col("severity"), F.col("actual_reading")))
        .withColumn("status", F.lit("OPEN"))
    )


COOLDOWN_S = 600
COOLDOWN_SCHEMA = (
    "id STRING, building_id STRING, meter_id STRING, timestamp TIMESTAMP_NTZ, opened_at TIMESTAMP_NTZ, "
    "actual_reading DOUBLE, anomaly_score DOUBLE, severity STRING, updates INT"
)


def cooldown_step(open_row: dict | None, event: dict) -> tuple[dict | None, dict]:
    """One step of the cooldown rule: ``(closed incident or None, open incident)``.

    Within ten minutes of the open incident's time a higher reading moves it
    there (so the window rolls), a lower one is dropped.
    """
    if open_row is not None and event["timestamp"] - open_row["timestamp"] <= pd.Timedelta(seconds=COOLDOWN_S):
        if event["actual_kwh"] > open_row["actual_reading"]:
            open_row = {
                **open_row,
                "timestamp": event["timestamp"],
                "actual_reading": event["actual_kwh"],
                "anomaly_score": max(open_row["anomaly_score"], event["anomaly_score"]),
                "severity": event["severity"],
                "updates": open_row["updates"] + 1,
            }
        return None, open_row
    opened = {
        "id": "ANOM-LIVE-" + str(event["id"]), "event_id": event["id"], "building_id": event["building_id"], "meter_id": event["meter_id"],
        "timestamp": event["timestamp"], "opened_at": event["timestamp"], "actual_reading": event["actual_kwh"],
        "anomaly_score": event["anomaly_score"], "severity": event["severity"], "updates": 0,
    }
    return open_row, opened


#: What a block gives for a possible first holder: the holder of a later block that its chain leads to.
HOP_SCHEMA = "meter_id STRING, day LONG, ts LONG, id LONG, to_ts LONG, to_id LONG"
RUN_SCHEMA = (
    "meter_id STRING, building_id STRING, first_id LONG, opened_at TIMESTAMP_NTZ, timestamp TIMESTAMP_NTZ, "
    "actual_reading DOUBLE, anomaly_score DOUBLE, severity STRING, updates INT"
)
#: Microseconds of a block of one meter's events, and of the cooldown.
BLOCK_US, COOLDOWN_US = 86_400_000_000, COOLDOWN_S * 1_000_000


def successors(ts: np.ndarray, kwh: np.ndarray, n: int) -> np.ndarray:
    """For each of the first ``n`` events, in order of time, the event that holds the incident after it.

    That is the first higher one within ten minutes, else the first one after them; the number of events
    stands for none.
    """
    higher, waiting = [len(ts)] * len(ts), []
    for k, v in enumerate(kwh.tolist()):
        while waiting and kwh[waiting[-1]] < v:
            higher[waiting.pop()] = k
        waiting.append(k)
    higher = np.array(higher[:n], np.int64)
    after = np.searchsorted(ts, ts[:n] + COOLDOWN_US, "right")
    return np.where((higher < len(ts)) & (higher < after), higher, after)


def _day_of_events(rows: pa.Table) -> tuple[pa.Table, int, np.ndarray, np.ndarray]:
    """A block's events in order, how many are its own, their times, and the place after each."""
    rows = rows.combine_chunks().sort_by([("ts", "ascending"), ("id", "ascending")])
    ts, n = rows["ts"].to_numpy(), int(rows["own"].to_numpy(zero_copy_only=False).sum())
    return rows, n, ts, successors(ts, rows["actual_kwh"].to_numpy(), n)


def _hops(rows: pa.Table) -> pa.Table:
    """Where the chain leads that enters the block at each event where it may be entered."""
    rows, n, ts, after = _day_of_events(rows)
    leaves = after.copy()
    for k in range(n - 1, -1, -1):
        if after[k] < n:
            leaves[k] = leaves[after[k]]
    day = rows["day"][0].as_py()
    early = np.searchsorted(ts[:n], day * BLOCK_US + COOLDOWN_US, "right")
    may = np.zeros(n, bool)
    may[: min(n, early + 1)] = True
    may |= rows["begins"].to_numpy(zero_copy_only=False)[:n]
    at, ids = np.flatnonzero(may), rows["id"].to_numpy()
    to = [int(k) if k < len(ts) else None for k in leaves[at]]
    pick = lambda values: pa.array([None if k is None else int(values[k]) for k in to], pa.int64())
    return pa.table(
        [pa.array([rows["meter_id"][0].as_py()] * len(at), pa.string()), pa.array([day] * len(at), pa.int64()), pa.array(ts[at]), pa.array(ids[at]), pick(ts), pick(ids)],
        names=["meter_id", "day", "ts", "id", "to_ts", "to_id"],
    )


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows each meter's chain from block to block over hops in order of meter and time; holds one place."""
    meter, place = object(), None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("meter_id", "day", "ts", "id", "to_ts", "to_id", "from_ts", "from_id")]
        used: list = []
        for m, day, ts, key, to_ts, to_id, from_ts, from_id in zip(*columns):
            if m != meter:
                meter, place = m, (from_ts, from_id)
            if (ts, key) == place:
                used.append((m, day, key))
                place = (to_ts, to_id)
        if used:
            m, day, key = zip(*used)
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.string()), pa.array(day, pa.int64()), pa.array(key, pa.int64())], ["meter_id", "day", "entry"])


def _runs(rows: pa.Table) -> pa.Table:
    """The incidents of a block from its first holder on; the first may continue one of an earlier block."""
    rows, n, ts, after = _day_of_events(rows)
    ids = rows["id"].to_numpy()
    chain = [int(np.flatnonzero(ids[:n] == rows["entry"][0].as_py())[0])]
    while after[chain[-1]] < n:
        chain.append(int(after[chain[-1]]))
    chain = np.array(chain)
    opens = np.r_[True, ts[chain[1:]] - ts[chain[:-1]] > COOLDOWN_US]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(chain)) - 1
    take = lambda c, k: rows[c].take(pa.array(chain[k]))
    score = np.maximum.reduceat(rows["anomaly_score"].to_numpy()[chain], first)
    columns = [take("meter_id", last), take("building_id", last), take("id", first), take("timestamp", first), take("timestamp", last), take("actual_kwh", last), pa.array(score), take("severity", last), pa.array(last - first, pa.int32())]
    return pa.table(columns, names=[c.split()[0] for c in RUN_SCHEMA.split(", ")])


def cooldown_blocks(own: DataFrame, starts: DataFrame) -> DataFrame:
    """Events by meter and day with all that a day's chain may lead to: ``own`` marks the day's events.

    Those of the next day's first ten minutes are copied to the day before, and so is the first event after
    them. ``starts`` (meter_id, from_ts, from_id) marks where a chain begins.
    """
    placed = own.withColumn("ts", micros(F.col("timestamp"))).withColumn("day", F.floor(F.col("ts") / BLOCK_US))
    early = F.col("ts") <= F.col("day") * BLOCK_US + COOLDOWN_US
    event = F.struct("ts", "id", "actual_kwh")
    days = placed.groupBy("meter_id", "day").agg(F.min(event).alias("any"), F.min(F.when(~early, event)).alias("late"))
    order = Window.partitionBy("meter_id").orderBy("day")
    following = F.lead(F.struct("day", "any", "late")).over(order)
    # the next day's first event past its early ones, or the first event of the day after that
    second = F.lead("any", 2).over(order)
    days = days.withColumn("_n", following).withColumn("_s", second)
    adjacent = F.col("_n.day") == F.col("day") + 1
    beyond = F.when(~adjacent, F.col("_n.any")).otherwise(F.coalesce(F.col("_n.late"), F.col("_s")))
    copies = days.withColumn("_b", beyond).filter(F.col("_b").isNotNull()).select("meter_id", "day", "_b.*")
    halo = placed.filter(early).select("meter_id", (F.col("day") - 1).alias("day"), "ts", "id", "actual_kwh")
    halo = halo.join(days.select("meter_id", "day"), ["meter_id", "day"], "left_semi")
    begin = starts.select("meter_id", F.col("from_id").alias("id"), F.lit(True).alias("begins"))
    marked = placed.join(begin, ["meter_id", "id"], "left").withColumn("begins", F.coalesce("begins", F.lit(False)))
    both = marked.withColumn("own", F.lit(True)).unionByName(halo.unionByName(copies).withColumn("own", F.lit(False)), allowMissingColumns=True)
    return both.select("meter_id", "day", "ts", "id", "actual_kwh", "own", F.coalesce("begins", F.lit(False)).alias("begins"), "building_id", "timestamp", "anomaly_score", "severity")


def incident_cooldown(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Flagged events to incidents, at most one open per meter and ten minutes.

    Which event holds a meter's incident next depends on the present holder alone, so each day of a meter
    finds all successors apart from the others, and where a chain entering the day would leave it. A day
    can only be entered in its first ten minutes or at the event after them; one pass over these few
    events of each meter tells where its days are entered, and the days then give their incidents. Events
    without a meter always open an incident.

    ``stored`` (id, building_id, meter_id, timestamp, opened_at, actual_reading, anomaly_score, severity,
    status) are incidents from before: the newest OPEN one of a meter goes on, and is returned if an event
    changed it.
    """
    alone = events.filter(F.col("meter_id").isNull()).select(
        F.concat(F.lit("ANOM-LIVE-"), F.col("id").cast("string")).alias("id"), "building_id",
        F.col("meter_id").cast("string").alias("meter_id"), "timestamp", F.col("timestamp").alias("opened_at"),
        F.col("actual_kwh").alias("actual_reading"), "anomaly_score", "severity", F.lit(0).alias("updates"),
    )
    own = events.filter(F.col("meter_id").isNotNull()).select(
        F.col("id").cast("long").alias("id"), "building_id", F.col("meter_id").cast("string").alias("meter_id"), "timestamp",
        F.col("actual_kwh").cast("double").alias("actual_kwh"), F.col("anomaly_score").cast("double").alias("anomaly_score"), "severity",
    )
    at = F.struct(micros(F.col("timestamp")).alias("ts"), "id")
    if stored is None:
        begin = own.groupBy("meter_id").agg(F.min(at).alias("_f"))
        before = None
    else:
        opened = stored.filter((F.col("status") == "OPEN") & F.col("meter_id").isNotNull()).withColumn("meter_id", F.col("meter_id").cast("string"))
        before = rows.newest(opened, ["meter_id"], [F.col("timestamp").desc(), F.col("id").desc()], 1)
        held = before.select("meter_id", micros(F.col("timestamp")).alias("_t"), F.col("actual_reading").alias("_a"))
        past = micros(F.col("timestamp")) > F.col("_t") + COOLDOWN_US
        takes = F.col("_t").isNull() | past | (F.col("actual_kwh") > F.col("_a"))
        begin = own.join(held, "meter_id", "left").filter(takes).groupBy("meter_id").agg(F.min(at).alias("_f"))
    starts = cut_lineage(begin.select("meter_id", F.col("_f.ts").alias("from_ts"), F.col("_f.id").alias("from_id")), "starts")
    blocks = cut_lineage(cooldown_blocks(own, starts), "cooldown")
    hops = blocks.select("meter_id", "day", "ts", "id", "actual_kwh", "own", "begins").groupBy("meter_id", "day").applyInArrow(_hops, HOP_SCHEMA)
    walk = hops.join(starts, "meter_id").repartition("meter_id").sortWithinPartitions("meter_id", "ts", "id")
    entered = walk.mapInArrow(_entered, "meter_id STRING, day LONG, entry LONG")
    runs = blocks.join(entered, ["meter_id", "day"]).groupBy("meter_id", "day").applyInArrow(_runs, RUN_SCHEMA)
    runs = runs.select("*", F.lit(None).cast("string").alias("stored_id"))
    if before is not None:
        runs = runs.unionByName(
            before.join(starts, "meter_id", "left_semi").select(
                "meter_id", "building_id", F.lit(-1).cast("long").alias("first_id"), "opened_at", "timestamp", "actual_reading",
                "anomaly_score", "severity", F.lit(0).alias("updates"), F.col("id").cast("string").alias("stored_id"),
            )
        )
    order = Window.partitionBy("meter_id").orderBy(F.col("stored_id").isNull(), "opened_at", "first_id")
    gap = elapsed(F.col("opened_at"), F.lag("timestamp").over(order))
    continues = F.coalesce(gap <= COOLDOWN_S, F.lit(False))
    new = F.when(~continues, F.coalesce("stored_id", F.concat(F.lit("ANOM-LIVE-"), F.col("first_id").cast("string"))))
    joined = runs.withColumn("_new", new).withColumn(
        "_incident", F.last("_new", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_place", F.row_number().over(order))
    whole = joined.groupBy("meter_id", "_incident").agg(
        F.max_by(F.struct("building_id", "timestamp", "actual_reading", "severity"), "_place").alias("_l"),
        F.min_by("opened_at", "_place").alias("opened_at"), F.max("anomaly_score").alias("anomaly_score"),
        (F.sum("updates") + F.count(F.lit(1)) - 1).cast("int").alias("updates"), F.max("stored_id").alias("stored_id"),
    )
    merged = whole.filter(F.col("stored_id").isNull() | (F.col("updates") > 0)).select(
        F.col("_incident").alias("id"), "_l.building_id", "meter_id",
        "_l.timestamp", "opened_at", "_l.actual_reading", "anomaly_score", "_l.severity", "updates",
    )
    return merged.unionByName(alone)


def status_transition(requests: DataFrame, current: DataFrame, at: str) -> DataFrame:
    """Outcome of status requests, with the history they would leave.

    A request names the status and history length it has seen. Another state
    in store, or an earlier request in the same batch, is a conflict.
    """
    empty = F.from_json(F.lit("[]"), HISTORY_TYPE)
    stored = current.select(
        "id", F.coalesce("status", F.lit("OPEN")).alias("previous_status"),
        F.coalesce("status_history", empty).alias("_h"),
    )
    valid = requests.withColumn("_ok", F.col("status").isin(*S.STATUSES))
    first = valid.filter("_ok").groupBy("id").agg(F.min("request_id").alias("_first"))
    joined = valid.join(first, "id", "left").join(stored, "id", "left")
    outcome = (
        F.when(~F.col("_ok"), "invalid_status")
        .when(F.col("previous_status").isNull(), "not_found")
        .when(
            (F.col("seen_status") != F.col("previous_status"))
            | (F.col("seen_history") != F.size("_h"))
            | (F.col("request_id") > F.col("_first")),
            "conflict",
        )
        .otherwise("updated")
    )
    entry = F.struct(
        F.col("previous_status"), F.col("status"), F.col("note"),
        F.lit(at).alias("updated_at"), F.lit("operator").alias("actor"),
    )
    return (
        joined.withColumn("outcome", outcome)
        .withColumn("status_history", F.when(F.col("outcome") == "updated", F.concat("_h", F.array(entry))).otherwise(F.col("_h")))
        .withColumn(
            "current_status", F.when(F.col("outcome") == "updated", F.col("status")).otherwise(F.col("previous_status"))
        )
        .select("request_id", "id", "outcome", "previous_status", "current_status", "status_history")
    )


def persist_events(stored: DataFrame, incoming: DataFrame, arrival: str) -> DataFrame:
    """Insert if absent: what is stored never changes."""
    fresh = rows.first_per_key(incoming, ["id"], [F.col(arrival)]).join(stored.select("id"), "id", "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def incident_union(current: DataFrame, stored: DataFrame, arrival: str) -> DataFrame:
    """Current detections and all stored incidents; the stored version wins."""
    fresh = (
        rows.first_per_key(current, ["id"], [F.col(arrival).desc()])
        .join(stored.select("id"), "id", "left_anti")
        .withColumn("status", F.lit("OPEN"))
    )
    return stored.unionByName(fresh.select(*stored.columns))


def incident_view(incidents: DataFrame) -> DataFrame:
    """Snapshot as the base, columns over it; unknown estimates stay unknown."""
    schema = (
        "subsystem STRING, predicted_kwh DOUBLE, delta_kwh DOUBLE, outdoor_temp_c DOUBLE, "
        "estimated_waste_vnd DOUBLE, estimated_waste_usd DOUBLE, description STRING, anomaly_score DOUBLE, suggested_action STRING"
    )
    history = F.col("status_history") if "status_history" in incidents.columns else F.lit(None).cast("array<string>")
    return incidents.withColumn("_s", F.from_json("snapshot", schema)).select(
        "id", "building_id", "timestamp", "_s.*", F.coalesce(history, F.array()).alias("status_history"),
        F.initcap(F.lower("severity")).alias("severity"),
        F.col("actual_reading").alias("actual_kwh"), "status",
    )


def detector_quality(labelled: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall, F1 and false-positive rate against labels, 0 where undefined."""
    truth, found = F.col("is_injected_anomaly"), F.col("is_anomaly")
    counts = labelled.groupBy(*keys).agg(
        F.count_if(truth & found).alias("tp"), F.count_if(~truth & found).alias("fp"),
        F.count_if(truth & ~found).alias("fn"), F.count_if(~truth).alias("negatives"),
        F.count_if(truth).alias("positive_count"), F.count(F.lit(1)).alias("total_count"),
    )

    def share(a: Column, b: Column) -> Column:
        return half_up(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 4)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *keys, share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
        share(tp * 2, tp * 2 + fp + fn).alias("f1"), share(fp, F.col("negatives")).alias("false_positive_rate"),
        "positive_count", "total_count",
    )


def inject_labelled_anomalies(series: DataFrame, scenario: str, noise: float = 0.0) -> DataFrame:
    """A clean series with a labelled anomaly planted per building.

    ``night_overrun`` holds eight hours from a Monday 22:00 at 750 kWh,
    ``peak_spike`` lifts four Tuesday peak hours to 2850 kWh. Jitter comes
    from a hash of the row, so a repeat gives the same table.
    """
    whole = Window.partitionBy("building_id")
    order = whole.orderBy("timestamp")
    i, n = F.col("_i"), F.col("_n")
    hour, weekday = F.hour("timestamp"), F.weekday("timestamp")

    def first(where: Column) -> Column:
        return F.min(F.when(where, i)).over(whole)

    if scenario == "night_overrun":
        target, within = 750.0, (i >= 24) & (i < n - 10)
        start = F.coalesce(
            first(within & (weekday == 0) & (hour == 22)), first(within & (weekday < 4) & (hour == 22)), F.lit(22)
        )
        hit = (i >= F.col("_start")) & (i < F.col("_start") + 8)
    elif scenario == "peak_spike":
        target, within = 2850.0, (i >= 24) & (i < n - 30)
        start = F.coalesce(first(within & (weekday == 1) & (hour == 0)), F.lit(24))
        hit = (i - F.col("_start")).isin(10, 11, 18, 19)
    else:
        raise ValueError(f"unknown scenario: {scenario}")

    def uniform(seed: int) -> Column:
        h = F.xxhash64("building_id", "timestamp", F.lit(seed))
        return (F.pmod(h, F.lit(1_000_003)) + 0.5) / 1_000_003.0

    normal = F.sqrt(F.log(uniform(1)) * -2.0) * F.cos(uniform(2) * 2.0 * F.pi())
    planted = half_up(F.lit(target) + normal * noise, 2)
    return (
        series.withColumn("_i", F.row_number().over(order) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_start", start)
        .withColumn("is_injected_anomaly", hit)
        .withColumn("meter_reading", F.when(F.col("is_injected_anomaly"), planted).otherwise(F.col("meter_reading")))
        .drop("_i", "_n", "_start")
    )
