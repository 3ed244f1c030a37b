"""Ingest, access scope and ownership: joins, anti joins and range joins.

No join is hinted: the size of each side decides at run time, and AQE splits
hot keys of the shuffled ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.numeric import half_up
from wattloom.operators import rows
from wattloom.operators.aggregates import snapshot_number


def ntz(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def reading_problem() -> Column:
    """Reject reason found on the row itself."""
    kwh, humidity, interval = F.col("meter_reading_kwh"), F.col("relative_humidity_pct"), F.col("interval_seconds")
    bad = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return (
        F.when(kwh.isNull() | bad(kwh) | (kwh < 0), "bad_reading")
        .when(bad(humidity) | ~humidity.between(0, 100), "bad_humidity")
        .when(bad(interval) | (interval <= 0) | (interval > 86400), "bad_interval")
    )


def ingest_validate(readings: DataFrame, buildings: DataFrame, zones: DataFrame, meters: DataFrame) -> DataFrame:
    """Readings with ``meter_id`` and ``reason``; a null reason means accepted.

    Zones and meters become one lookup by building and zone first, so the
    readings meet two dimensions: their place, and the short building list.
    """
    total = F.lit("")
    known = buildings.select("building_id", F.lit(True).alias("_b"))
    zone = zones.select("building_id", F.col("zone_id").alias("_zone"), F.lit(True).alias("_z"))
    meter = meters.select("building_id", F.coalesce("zone_id", total).alias("_zone"), F.col("meter_id").alias("_meter"))
    place = zone.join(meter, ["building_id", "_zone"], "full")
    joined = (
        readings.withColumn("_zone", F.coalesce("zone_id", total))
        .join(known, "building_id", "left")
        .join(place, ["building_id", "_zone"], "left")
    )
    reason = F.coalesce(
        reading_problem(),
        F.when(F.col("_b").isNull(), "unknown_building"),
        F.when(F.col("zone_id").isNotNull() & F.col("_z").isNull(), "unknown_zone"),
        F.when(F.col("_meter").isNull(), "no_meter"),
    )
    return joined.select(*[c for c in readings.columns if c != "meter_id"], F.col("_meter").alias("meter_id"), reason.alias("reason"))


def ingest_dedup(incoming: DataFrame, stored: DataFrame, arrival: str) -> DataFrame:
    """New rows only: a stored row wins, then the first of the batch.

    The zone may be null (building total), so keys compare null-safe.
    """
    keys = ["building_id", "zone_id", "timestamp"]
    first = rows.first_per_key(incoming, keys, [F.col(arrival)])
    old = stored.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = (
        (first.building_id == old._building_id)
        & first.zone_id.eqNullSafe(old._zone_id)
        & (first.timestamp == old._timestamp)
    )
    return first.join(old, same, "left_anti")


def keep_lowest_id(readings: DataFrame) -> DataFrame:
    """The same rule for an old table: of equal keys the lowest id stays."""
    return rows.first_per_key(readings, ["building_id", "zone_id", "timestamp"], [F.col("id")])


def ingest_targets(
    buildings: DataFrame, zones: DataFrame, meters: DataFrame, units: DataFrame, households: DataFrame
) -> DataFrame:
    """Zones that should report."""
    open_units = (
        units.filter("active")
        .join(households.filter(F.col("ends_at").isNull()), "unit_id", "left_semi")
        .select("unit_id", F.lit(True).alias("_lived_in"))
    )
    return (
        zones.join(meters.select("zone_id", "scope"), "zone_id")
        .join(buildings.select("building_id", "building_type"), "building_id")
        .join(open_units, "unit_id", "left")
        .filter((F.col("building_type") != "Residential") | (F.col("scope") == "COMMON") | F.col("_lived_in"))
        .select("building_id", "building_type", "zone_id")
    )


def occupancies(members: DataFrame, households: DataFrame, now: str) -> DataFrame:
    """Period in which a member may see the unit's meters."""
    return members.join(
        households.select("household_id", "unit_id", F.col("starts_at").alias("_hs"), F.col("ends_at").alias("_he")),
        "household_id",
    ).select(
        "member_id", "household_id", "unit_id",
        F.greatest("starts_at", "_hs").alias("since"),
        F.when(F.col("_he") < ntz(now), F.col("_he")).otherwise(ntz(now)).alias("until"),
    )


def in_period(facts: DataFrame, periods: DataFrame, unit: str = "month") -> DataFrame:
    """Facts of a unit between ``since`` and ``until``, ends included.

    Periods are cut into calendar buckets that join the key, so a hot unit is
    spread over its months and a reading meets only the periods of its month.
    """
    step = {"month": "interval 1 month", "day": "interval 1 day"}[unit]
    cut = periods.filter(F.col("since") <= F.col("until")).withColumn(
        "_bucket",
        F.explode(F.sequence(F.trunc(F.to_date("since"), unit) if unit == "month" else F.to_date("since"),
                             F.to_date("until"), F.expr(step))),
    )
    where = F.trunc(F.to_date("timestamp"), unit) if unit == "month" else F.to_date("timestamp")
    return (
        facts.withColumn("_bucket", where)
        .join(cut, ["unit_id", "_bucket"])
        .filter(F.col("timestamp").between(F.col("since"), F.col("until")))
        .drop("_bucket")
    )


SCOPES = {"household": "UNIT", "common": "COMMON", "building": "BUILDING_TOTAL"}


def _of_kind(facts: DataFrame, meters: DataFrame, scope: str) -> DataFrame:
    """Facts of the meters behind a scope, with the meter's building."""
    kind = meters.filter(F.col("scope") == SCOPES[scope]).select("unit_id", "building_id")
    return facts.join(kind, "unit_id").withColumn("scope", F.lit(scope))


def in_scope(
    facts: DataFrame, members: DataFrame, households: DataFrame, units: DataFrame, meters: DataFrame, now: str
) -> DataFrame:
    """Facts with ``scope`` and the ``member_id`` or, in shared scopes, the ``building_id`` that may see them.

    A member sees the unit's meters while the member's and the household's periods last. Common meters and
    building totals are seen, up to ``now``, by whoever lives in the building now: they are listed once for
    each building with such a member, not once per member.
    """
    own = in_period(_of_kind(facts, meters, "household"), occupancies(members, households, now)).drop("since", "until")
    lived_in = current_members(members, households, units, now).select("building_id").distinct()
    until = facts.filter(F.col("timestamp") <= ntz(now))
    for scope in ("common", "building"):
        shared = _of_kind(until, meters, scope).join(lived_in, "building_id", "left_semi")
        own = own.unionByName(shared, allowMissingColumns=True)
    return own


def scoped_readings(
    readings: DataFrame, members: DataFrame, households: DataFrame, units: DataFrame, meters: DataFrame, now: str
) -> DataFrame:
    """Readings that members may see, see :func:`in_scope`."""
    return in_scope(readings, members, households, units, meters, now)


def scoped_incidents(
    incidents: DataFrame, members: DataFrame, households: DataFrame, units: DataFrame, meters: DataFrame, now: str, limit: int = 100
) -> DataFrame:
    """The newest incidents of each member, and of each building's shared scopes; figures missing from the snapshot stay null."""
    seen = in_scope(incidents, members, households, units, meters, now)
    shared = F.when(F.col("member_id").isNull(), F.col("building_id"))
    last = rows.newest(seen.withColumn("_shared", shared), ["scope", "member_id", "_shared"], [F.col("timestamp").desc(), F.col("id").desc()], limit)
    names = ["predicted_kwh", "delta_kwh", "estimated_waste_vnd"]
    return last.withColumns({n: snapshot_number(n) for n in names}).drop("snapshot", "_shared")


def current_members(members: DataFrame, households: DataFrame, units: DataFrame, now: str) -> DataFrame:
    """Members whose own and household periods contain ``now``; ends are open."""
    at = ntz(now)

    def holds(start: str, end: str) -> Column:
        return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))

    living = households.filter(holds("starts_at", "ends_at")).select("household_id", "unit_id")
    return (
        members.filter(holds("starts_at", "ends_at"))
        .join(living, "household_id")
        .join(units.filter("active").select("unit_id", "building_id"), "unit_id")
        .select("member_id", "household_id", "unit_id", "building_id")
    )


def operator_role(users: DataFrame, staff: DataFrame) -> DataFrame:
    roles = staff.groupBy("user_id").agg(F.bool_or(F.col("role") == "MANAGER").alias("_manager"))
    return users.join(roles, "user_id", "left").select(
        "user_id",
        F.when(F.col("is_platform_admin"), "ADMIN")
        .when(F.col("_manager"), "MANAGER")
        .when(F.col("_manager").isNotNull(), "TECHNICIAN")
        .alias("role"),
    )


def ownership_violations(meters: DataFrame, units: DataFrame, zones: DataFrame, readings: DataFrame) -> DataFrame:
    """Rows that break an ownership rule, with the rule's name."""
    u = units.select(F.col("unit_id").alias("_u"), F.col("building_id").alias("_b"))
    z = zones.select(F.col("zone_id").alias("_z"), F.col("building_id").alias("_b"), F.col("unit_id").alias("_u"))
    m = meters.select(F.col("meter_id").alias("_m"), F.col("building_id").alias("_b"), F.col("zone_id").alias("_z"))
    c = F.col
    foreign = meters.filter(c("unit_id").isNotNull()).join(
        u, (c("unit_id") == c("_u")) & (c("building_id") == c("_b")), "left_anti"
    )
    mismatch = meters.filter(c("zone_id").isNotNull()).join(
        z, (c("zone_id") == c("_z")) & (c("building_id") == c("_b")) & c("unit_id").eqNullSafe(c("_u")), "left_anti"
    )
    strays = readings.filter(c("meter_id").isNotNull()).join(
        m, (c("meter_id") == c("_m")) & (c("building_id") == c("_b")) & c("zone_id").eqNullSafe(c("_z")), "left_anti"
    )
    wrong_scope = meters.filter(
        ~(
            ((c("scope") == "UNIT") & c("unit_id").isNotNull())
            | (c("scope").isin("BUILDING_TOTAL", "COMMON", "UNASSIGNED") & c("unit_id").isNull())
        )
    )

    def named(df: DataFrame, key: str, rule: str) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), c(key).alias("row_key"))

    return (
        named(foreign, "meter_id", "meter_unit_of_other_building")
        .unionByName(named(mismatch, "meter_id", "meter_zone_mismatch"))
        .unionByName(named(strays, "reading_id", "reading_meter_mismatch"))
        .unionByName(named(wrong_scope, "meter_id", "scope_unit_check"))
    )


def cascade_survivors(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left after seed households nobody uses are removed, and all that hangs on them.

    ``tables``: households(household_id, unit_id, is_seed), members and
    invitations(household_id), units(unit_id, is_seed), zones and
    meters(unit_id), readings and events(meter_id).
    """
    households = tables["households"]
    unused = (
        households.filter("is_seed")
        .join(tables["members"], "household_id", "left_anti")
        .join(tables["invitations"], "household_id", "left_anti")
    )
    left = households.join(unused.select("household_id"), "household_id", "left_anti")
    gone = tables["units"].filter("is_seed").join(left, "unit_id", "left_anti").select("unit_id")
    gone_meters = tables["meters"].join(gone, "unit_id", "left_semi").select("meter_id")
    out = {"households": left}
    for name in ("units", "zones", "meters"):
        out[name] = tables[name].join(gone, "unit_id", "left_anti")
    for name in ("readings", "events"):
        out[name] = tables[name].join(gone_meters, "meter_id", "left_anti")
    return out


def remaining_units(left: dict[str, DataFrame]) -> DataFrame:
    """Units that stay, each with its households and zones."""
    return (
        left["units"].select("unit_id")
        .join(left["households"].select("unit_id", "household_id"), "unit_id", "left")
        .join(left["zones"].select("unit_id", "zone_id"), "unit_id", "left")
    )


def unit_roster(
    units: DataFrame, households: DataFrame, members: DataFrame, invitations: DataFrame, zones: DataFrame, now: str
) -> DataFrame:
    """One row per unit and household, with its members and live invitations nested, and the unit's zones.

    A unit without households has one row; a zone without unit has one of its own. What is nested
    belongs to one household or one unit, so no list grows with the tables.
    """

    def nested(df: DataFrame, key: str, item: str, out: str) -> DataFrame:
        return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(item))).alias(out))

    live = invitations.filter(F.col("accepted_at").isNull() & (F.col("expires_at") > ntz(now)))
    home = (
        households.select("household_id", "unit_id", "starts_at", "ends_at")
        .join(nested(members, "household_id", "member_id", "members"), "household_id", "left")
        .join(nested(live, "household_id", "invitation_id", "invitations"), "household_id", "left")
    )
    own = nested(zones.filter(F.col("unit_id").isNotNull()), "unit_id", "zone_id", "zones")
    roster = units.select("unit_id", "building_id").join(home, "unit_id", "left").join(own, "unit_id", "left")
    loose = zones.filter(F.col("unit_id").isNull()).select(
        F.lit(None).cast(units.schema["unit_id"].dataType).alias("unit_id"), "building_id",
        F.array(F.struct("zone_id")).alias("zones"),
    )
    return roster.unionByName(loose, allowMissingColumns=True)


def observed_plus_forecast(observed: DataFrame, forecast: DataFrame, window: int = 72) -> DataFrame:
    """The last observed points, then future points without an actual value."""
    last = rows.newest(observed, ["building_id"], [F.col("timestamp").desc()], window)
    future = forecast.withColumn("is_anomaly", F.lit(False))
    lower, upper = F.col("lower_bound_95"), F.col("upper_bound_95")
    finite = ~(F.isnan(lower) | F.isnan(upper))
    return last.unionByName(future, allowMissingColumns=True).withColumn(
        "confidence_interval_95", F.when(lower.isNotNull() & upper.isNotNull() & finite, F.array(lower, upper))
    )


def recent_events(
    events: DataFrame, key: str, limit: int, severity: str | None = None, retention: int = 1000, arrival: str = "arrival"
) -> DataFrame:
    """The last ``limit`` to arrive among the last ``retention``, optionally of one severity; event time plays no part."""
    order = [F.col(arrival).desc(), F.col("id").desc()]
    kept = rows.newest(events, [key], order, retention)
    if severity:
        kept = kept.filter(F.col("severity") == severity.upper())
    return rows.newest(kept, [key], order, limit)


def conversation_tail(turns: DataFrame, follow_up: Column, limit: int = 10) -> DataFrame:
    """Last turns of each session; a short follow-up takes the turn before it as context."""
    last = rows.newest(turns, ["session_id"], [F.col("turn").desc()], limit + 1)
    order = Window.partitionBy("session_id").orderBy("turn")
    back = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    return (
        last.withColumn("_before", F.lag(F.lower("message")).over(order))
        .withColumn("_k", F.row_number().over(back))
        .filter(F.col("_k") <= limit)
        .withColumn("is_follow_up", (F.col("role") == "user") & follow_up)
        .withColumn("context", F.when(F.col("is_follow_up"), F.col("_before")))
        .drop("_before", "_k")
    )


def round_columns(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: half_up(F.col(n), digits) for n in names})
