"""Continuous ingest, aggregation and detection with Structured Streaming.

Event time is a TIMESTAMP here, as watermarks need. A trigger limits how much
a micro-batch holds (``maxFilesPerTrigger`` or the broker's offset limit), so
the rows of one key within a batch are bounded too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wattloom.functions import rules
from wattloom.functions import settings as S
from wattloom.functions.numeric import half_up
from wattloom.operators import relations, rows
from wattloom.operators.incidents import COOLDOWN_S, COOLDOWN_SCHEMA, successors
from wattloom.session import folder_exists

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT_SCHEMA = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def read_files(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_trigger: int = 64) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def start(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Starts a stream with a state store per core under a local master.

    A stream keeps the partition count of its first start; the default of
    200 stores is for clusters, which choose their own. State lies in RocksDB,
    which processors with timers and initial state need, and which keeps
    large state out of the heap.
    """
    context, setting, store = spark.sparkContext, "spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass"
    before, used = spark.conf.get(setting), spark.conf.get(store)
    if context.master.startswith("local"):
        spark.conf.set(setting, str(min(int(before), context.defaultParallelism)))
    spark.conf.set(store, ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.set(setting, before)
        spark.conf.set(store, used)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Processes all that is there into parquet and returns the table."""
    writer = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
    finish(start(stream.sparkSession, writer))
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    failure = query.exception()
    if failure is not None:
        raise failure


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> None:
    writer = (
        stream.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
    finish(start(stream.sparkSession, writer))


def append_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that may be handed a batch twice: each batch overwrites its own folder."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def stream_ingest(
    readings: DataFrame, buildings: DataFrame, zones: DataFrame, meters: DataFrame, delay: str = "1 hour"
) -> DataFrame:
    """Accepted readings, once per meter and time; rows behind the watermark are dropped.

    Dimensions are static and join by equality; the state holds keys of the
    last ``delay`` only.
    """
    accepted = relations.ingest_validate(readings.withWatermark("timestamp", delay), buildings, zones, meters)
    return (
        accepted.filter(F.col("reason").isNull()).drop("reason")
        .dropDuplicatesWithinWatermark(["meter_id", "timestamp"])
    )


def stream_ingest_sink(
    readings: DataFrame, buildings: DataFrame, zones: DataFrame, meters: DataFrame, stored: DataFrame,
    accepted: str, rejected: str, checkpoint: str, arrival: str = "id",
) -> None:
    """Ingest with both outcomes: new readings to ``accepted``, the others with their ``reason`` to ``rejected``.

    A reading is new if neither ``stored`` nor an earlier batch holds its building, zone and time; of
    equal ones in a batch the first to arrive counts. However late a reading is, none is lost. Accepted
    rows lie in folders by day and batch, and a batch looks only into the days it has readings of, so it
    costs the same however long the stream goes on. A batch that is handed over twice overwrites its own
    folders and leaves the others as they were.
    """
    spark = readings.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        checked = relations.ingest_validate(batch, buildings, zones, meters).withColumn("day", F.to_date("timestamp")).persist()
        try:
            checked.filter(F.col("reason").isNotNull()).drop("day").write.mode("overwrite").parquet(f"{rejected}/batch={number}")
            good = checked.filter(F.col("reason").isNull()).drop("reason")
            days = [r[0] for r in good.select("day").distinct().collect()]  # of one batch, which a trigger bounds
            known = stored.filter(F.to_date("timestamp").isin(days)).select("building_id", "zone_id", "timestamp")
            there = [f for f in (f"{accepted}/day={d}" for d in days) if folder_exists(spark, f)]
            if there:
                before = spark.read.schema(good.drop("day").schema.add("batch", "long")).option("basePath", accepted).parquet(*there)
                known = known.unionByName(before.filter(F.col("batch") < number).select(*known.columns))
            fresh = relations.ingest_dedup(good, known, arrival).withColumn("batch", F.lit(number))
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(accepted)
        finally:
            checked.unpersist()

    run_batches(readings, handle, checkpoint, "append")


def stream_hourly(readings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Building series per tumbling hour, emitted once the hour is complete."""
    kwh, zone = F.col("meter_reading_kwh"), F.col("zone_id")
    return (
        readings.withWatermark("timestamp", delay)
        .groupBy("building_id", F.window("timestamp", "1 hour").alias("w"))
        .agg(
            half_up(
                F.coalesce(F.sum(F.when(zone.isNotNull(), kwh)), F.sum(F.when(zone.isNull(), kwh)), F.lit(0.0)), 4
            ).alias("meter_reading_kwh"),
            half_up(F.coalesce(F.avg("outdoor_temperature_c"), F.lit(S.DEFAULT_TEMPERATURE_C)), 2).alias("outdoor_temperature_c"),
        )
        .select("building_id", F.col("w.start").alias("timestamp"), "meter_reading_kwh", "outdoor_temperature_c")
    )


def stream_latest_zone(readings: DataFrame) -> DataFrame:
    """Newest reading per zone, for update mode; older or equal times change nothing."""
    return (
        readings.filter(F.col("zone_id").isNotNull())
        .groupBy("building_id", "zone_id")
        .agg(F.max_by(F.struct("timestamp", "meter_reading_kwh", "id"), F.struct("timestamp", "id")).alias("_l"))
        .select("building_id", "zone_id", "_l.*")
    )


def newest_versions(updates: DataFrame) -> DataFrame:
    """The table behind update-mode output: the newest row per zone."""
    return updates.groupBy("building_id", "zone_id").agg(
        F.max_by(F.struct("timestamp", "meter_reading_kwh", "id"), F.struct("timestamp", "id")).alias("_l")
    ).select("building_id", "zone_id", "_l.*")


#: Arrays as their bytes, as the rows of a whole first batch wait for the watermark: numbers one by one would take minutes.
SURGE_STATE = "readings BINARY, ts BINARY, id BINARY, kwh BINARY, label BINARY, score BINARY"
SURGE_KINDS = ("f8", "i8", "i8", "f8", "i8", "f8")
SURGE_SCHEMA = "id LONG, building_id STRING, timestamp TIMESTAMP, actual_kwh DOUBLE, lag_24h DOUBLE, forest_label LONG, anomaly_score DOUBLE"
HISTORY = 24


def _with_lag(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Adds to each reading the one ``HISTORY`` places before it, once the watermark has passed it.

    The state is the last readings that were given out, and those that wait in order of time.
    """
    held = state.get if state.exists else (b"",) * len(SURGE_KINDS)
    known, *waiting = (np.frombuffer(x, kind) for x, kind in zip(held, SURGE_KINDS))
    if not state.hasTimedOut:
        arrived = [[x] for x in waiting]
        for part in parts:
            new = (part["timestamp"].astype("datetime64[us]").astype("int64"), part["id"], part["meter_reading_kwh"], part["forest_label"], part["anomaly_score"])
            for pieces, y in zip(arrived, new):
                pieces.append(np.asarray(y, pieces[0].dtype))
        waiting = [np.concatenate(pieces) for pieces in arrived]
    order = np.lexsort((waiting[1], waiting[0]))
    waiting = [x[order] for x in waiting]
    passed = state.getCurrentWatermarkMs()
    n = int(np.searchsorted(waiting[0], passed * 1000, "left"))
    ts, ids, kwh, label, score = (x[:n] for x in waiting)
    values = np.concatenate([known, kwh])
    rest = [x[n:] for x in waiting]
    state.update((values[-HISTORY:].tobytes(), *[x.tobytes() for x in rest]))
    if len(rest[0]):
        state.setTimeoutTimestamp(max(int(rest[0][0]) // 1000, passed, 1))
    # with full history, the reading at place i of `values` lags the one HISTORY later
    first = max(0, HISTORY - len(known))
    if n > first:
        lags = values[len(known) + first - HISTORY : len(values) - HISTORY]
        yield pd.DataFrame(
            {
                "id": ids[first:], "building_id": key[0], "timestamp": ts[first:].astype("datetime64[us]"),
                "actual_kwh": kwh[first:], "lag_24h": lags, "forest_label": label[first:], "anomaly_score": score[first:],
            }
        )


def stream_surge(readings: DataFrame, threshold: float = 0.0, delay: str = "1 hour") -> DataFrame:
    """The surge rule on a stream, each reading judged in order of time once the watermark has passed it.

    Readings that arrive up to ``delay`` late take their place; later ones are dropped. A building's state
    is its last 24 readings and those of the last ``delay``. Python only keeps the order; the rule itself
    is columns.
    """
    lagged = readings.withWatermark("timestamp", delay).groupBy("building_id").applyInPandasWithState(
        _with_lag, SURGE_SCHEMA, SURGE_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    actual, score = F.col("actual_kwh"), F.col("anomaly_score")
    hit = (F.col("forest_label") == -1) | (score >= threshold) | (rules.surge_ratio(actual, F.col("lag_24h")) >= 2.5)
    return lagged.filter(hit).select(
        "id", "building_id", "timestamp", half_up(actual, 2).alias("actual_reading"), half_up(score, 4).alias("anomaly_score"),
        rules.severity(score, actual, F.col("lag_24h")).alias("severity"),
    )


INCIDENT_SCHEMA = COOLDOWN_SCHEMA.replace("TIMESTAMP_NTZ", "TIMESTAMP")
INCIDENT_FIELDS = [c.split()[0] for c in INCIDENT_SCHEMA.split(", ")]
#: A meter's open incident: times in microseconds.
OPEN_STATE = "id STRING, building_id STRING, at LONG, opened LONG, kwh DOUBLE, score DOUBLE, severity STRING, updates INT"


class Cooldown(StatefulProcessor):
    """Folds a meter's events into its open incident; a timer ends the incident when the watermark has passed its cooldown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN_STATE)

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        last = initialState.sort_values(["timestamp", "id"]).iloc[-1]
        at, opened = (int(last[c].value // 1000) for c in ("timestamp", "opened_at"))
        self._hold((last["id"], last["building_id"], at, opened, float(last["actual_reading"]), float(last["anomaly_score"]), last["severity"], 0), timerValues)

    def _hold(self, row: tuple, timers) -> None:
        self.open.update(row)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(row[2] // 1000 + COOLDOWN_S * 1000, timers.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.open.clear()
        yield pd.DataFrame(columns=INCIDENT_FIELDS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Emits each incident that was opened or changed, as it is after the batch."""
        events = pd.concat(list(rows)).sort_values(["timestamp", "id"], ignore_index=True)
        ts = events["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()
        kwh, score = events["actual_kwh"].to_numpy(float), events["anomaly_score"].to_numpy(float)
        after = successors(ts, kwh, len(ts))
        held = self.open.get() if self.open.exists() else None
        near = np.flatnonzero((kwh > held[4]) | (ts > held[2] + COOLDOWN_S * 1_000_000)) if held else np.arange(len(ts))
        chain = [int(near[0])] if len(near) else []
        while chain and after[chain[-1]] < len(ts):
            chain.append(int(after[chain[-1]]))
        changed: dict[str, tuple] = {}
        for k in chain:
            e = events.iloc[k]
            if held and ts[k] - held[2] <= COOLDOWN_S * 1_000_000:
                held = (held[0], held[1], int(ts[k]), held[3], float(kwh[k]), max(held[5], float(score[k])), e["severity"], held[7] + 1)
            else:
                held = ("ANOM-LIVE-" + str(e["id"]), e["building_id"], int(ts[k]), int(ts[k]), float(kwh[k]), float(score[k]), e["severity"], 0)
            changed[held[0]] = held
        if chain:
            self._hold(held, timerValues)
        at = lambda v: pd.Timestamp(v, unit="us")
        yield pd.DataFrame([(r[0], r[1], key[0], at(r[2]), at(r[3]), r[4], r[5], r[6], r[7]) for r in changed.values()], columns=INCIDENT_FIELDS)


def stream_cooldown(events: DataFrame, stored: DataFrame | None = None, delay: str = "10 minutes") -> DataFrame:
    """Flagged events to incident versions; the state of a meter expires with its cooldown.

    The last version of an incident (most updates) is what the batch operator returns. ``stored`` are the
    incidents from before, as there: the newest OPEN one of each meter is the state that the stream starts
    with. Events without a meter open an incident each. Needs the RocksDB state store, see :func:`start`.
    """
    own = events.filter(F.col("meter_id").isNotNull()).withWatermark("timestamp", delay)
    before = None
    if stored is not None:
        opened = stored.filter((F.col("status") == "OPEN") & F.col("meter_id").isNotNull())
        last = rows.newest(opened, ["meter_id"], [F.col("timestamp").desc(), F.col("id").desc()], 1)
        before = last.withColumns({c: F.col(c).cast("timestamp") for c in ("timestamp", "opened_at")}).groupBy("meter_id")
    folded = own.groupBy("meter_id").transformWithStateInPandas(Cooldown(), INCIDENT_SCHEMA, "append", "EventTime", before)
    alone = events.filter(F.col("meter_id").isNull()).select(
        F.concat(F.lit("ANOM-LIVE-"), F.col("id").cast("string")).alias("id"), "building_id", F.col("meter_id").cast("string").alias("meter_id"),
        "timestamp", F.col("timestamp").alias("opened_at"), F.col("actual_kwh").alias("actual_reading"), "anomaly_score", "severity", F.lit(0).alias("updates"),
    )
    return folded.unionByName(alone)


def stream_filter_sink(
    readings: DataFrame, building: str | None, stored: str, pushed: str, checkpoint: str, most: int = 20
) -> None:
    """Stores every batch; rows of one building go on to ``pushed`` when the batch is small."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{stored}/batch={number}")
            # looks at one row more than allowed, however large the batch is
            small = batch.limit(most + 1).count() <= most
            wanted = batch if building is None else batch.filter(F.col("building_id") == building)
            (wanted if small else wanted.limit(0)).write.mode("overwrite").parquet(f"{pushed}/batch={number}")
        finally:
            batch.unpersist()

    run_batches(readings, handle, checkpoint, "append")
