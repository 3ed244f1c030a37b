"""Ingest, access scope, ownership and incident sets on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.operators import relations
from wattloom.plans.registry import query
from wattloom.plans.views import Tables

THEN = "1999-01-01 00:00:00"


@query("operator_role", """
SELECT u.user_id, CASE WHEN u.is_platform_admin THEN 'ADMIN' WHEN s.m THEN 'MANAGER' WHEN s.m IS NOT NULL THEN 'TECHNICIAN' END AS role
FROM (SELECT c_custkey AS user_id, c_custkey % 50 = 0 AS is_platform_admin FROM customer) u
LEFT JOIN (SELECT o_custkey AS user_id, bool_or(o_orderpriority = '1-URGENT') AS m FROM orders GROUP BY 1) s ON s.user_id = u.user_id""")
def _(t: Tables) -> DataFrame:
    users = t.base("customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 50 == 0).alias("is_platform_admin"))
    staff = t.base("orders").select(
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "MANAGER").otherwise("TECHNICIAN").alias("role"),
    )
    return relations.operator_role(users, staff)


@query("ingest_validate", """
SELECT i.id, CASE WHEN i.kwh IS NULL OR i.kwh < 0 THEN 'bad_reading' WHEN NOT i.hum BETWEEN 0 AND 100 THEN 'bad_humidity' WHEN i.sec <= 0 OR i.sec > 86400 THEN 'bad_interval'
    WHEN i.building_id = 'b3' THEN 'unknown_building' WHEN i.zone_id = 'z_error' AND i.building_id <> 'b0' THEN 'unknown_zone' WHEN i.zone_id = 'z_view' THEN 'no_meter' END AS reason,
  CASE WHEN i.building_id = 'b3' OR coalesce(i.zone_id = 'z_view', false) THEN NULL ELSE i.meter_id END AS meter_id
FROM (SELECT id, building_id, zone_id, meter_id, CASE WHEN id % 23 = 0 THEN -meter_reading_kwh - 1 ELSE meter_reading_kwh END AS kwh,
        CASE WHEN id % 29 = 0 THEN 120.0 ELSE relative_humidity_pct END AS hum, CASE WHEN id % 31 = 0 THEN 0 ELSE 600 END AS sec FROM v_meter_reading) i""", ("v_meter_reading",))
def _(t: Tables) -> DataFrame:
    all_readings = t("v_meter_reading")
    i = F.col("id")
    incoming = all_readings.withColumns(
        {
            "meter_reading_kwh": F.when(i % 23 == 0, -F.col("meter_reading_kwh") - 1).otherwise(F.col("meter_reading_kwh")),
            "relative_humidity_pct": F.when(i % 29 == 0, F.lit(120.0)).otherwise(F.col("relative_humidity_pct")),
            "interval_seconds": F.when(i % 31 == 0, F.lit(0.0)).otherwise(F.lit(600.0)),
        }
    )
    places = all_readings.select("building_id", "zone_id", "meter_id").distinct().filter(F.col("building_id") != "b3")
    buildings = places.select("building_id").distinct()
    zones = places.filter(F.col("zone_id").isNotNull() & ((F.col("zone_id") != "z_error") | (F.col("building_id") == "b0")))
    meters = places.filter(F.coalesce(F.col("zone_id") != "z_view", F.lit(True)))
    return relations.ingest_validate(incoming, buildings, zones, meters).select("id", "reason", "meter_id")


@query("ingest_dedup", """
SELECT id, building_id, zone_id, timestamp, arrival FROM (
  SELECT *, row_number() OVER (PARTITION BY building_id, zone_id, timestamp ORDER BY arrival) AS n FROM (
    SELECT id, building_id, zone_id, date_trunc('minute', timestamp) AS timestamp, id * 2 + c AS arrival FROM v_telemetry, (SELECT unnest([0, 1]) AS c) k) i) q
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM v_telemetry s WHERE s.id % 3 = 0 AND s.building_id = q.building_id AND s.zone_id IS NOT DISTINCT FROM q.zone_id AND date_trunc('minute', s.timestamp) = q.timestamp)""", ("v_telemetry",))
def _(t: Tables) -> DataFrame:
    minute = F.date_trunc("minute", "timestamp").cast("timestamp_ntz")
    readings = t("v_telemetry").select("id", "building_id", "zone_id", minute.alias("timestamp"))
    twice = readings.withColumn("_c", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "id", "building_id", "zone_id", "timestamp", (F.col("id") * 2 + F.col("_c")).alias("arrival")
    )
    return relations.ingest_dedup(twice, readings.filter(F.col("id") % 3 == 0), "arrival")


@query("ingest_targets", """
SELECT CAST(z.building_id AS BIGINT) AS building_id, CASE WHEN z.building_id % 2 = 0 THEN 'Residential' ELSE 'Office' END AS building_type, 'zu' || CAST(z.unit_id AS STRING) AS zone_id FROM v_unit z
WHERE z.unit_id % 7 <> 0 AND (z.building_id % 2 = 1 OR z.unit_id % 5 = 0 OR (z.active AND EXISTS (SELECT 1 FROM v_household h WHERE h.unit_id = z.unit_id AND h.ends_at IS NULL)))""", ("v_unit", "v_household"))
def _(t: Tables) -> DataFrame:
    units = t("v_unit")
    zone = F.concat(F.lit("zu"), F.col("unit_id").cast("string")).alias("zone_id")
    zones = units.select(zone, "building_id", "unit_id")
    meters = units.filter(F.col("unit_id") % 7 != 0).select(zone, F.when(F.col("unit_id") % 5 == 0, "COMMON").otherwise("UNIT").alias("scope"))
    buildings = t.base("nation").select(
        F.col("n_nationkey").alias("building_id"),
        F.when(F.col("n_nationkey") % 2 == 0, "Residential").otherwise("Office").alias("building_type"),
    )
    return relations.ingest_targets(buildings, zones, meters, units, t("v_household"))


OCCUPANCY = f"""
SELECT m.member_id, m.household_id, h.unit_id, greatest(m.starts_at, h.starts_at) AS since, CASE WHEN h.ends_at < TIMESTAMP '{THEN}' THEN h.ends_at ELSE TIMESTAMP '{THEN}' END AS until
FROM v_member m JOIN v_household h ON h.household_id = m.household_id"""


LIVED_IN = f"""
SELECT DISTINCT u.building_id FROM v_member m JOIN v_household h ON h.household_id = m.household_id JOIN v_unit u ON u.unit_id = h.unit_id
WHERE u.active AND m.starts_at <= TIMESTAMP '{THEN}' AND (m.ends_at IS NULL OR m.ends_at > TIMESTAMP '{THEN}') AND h.starts_at <= TIMESTAMP '{THEN}' AND (h.ends_at IS NULL OR h.ends_at > TIMESTAMP '{THEN}')"""


def in_scope_sql(facts: str) -> str:
    """Rows of ``facts`` by scope: a member's own while the periods last, shared ones of buildings where somebody lives."""
    return f"""
SELECT 'household' AS scope, o.member_id, o.household_id, k.building_id, r.* FROM {facts} r JOIN v_unit_meter k ON k.unit_id = r.unit_id AND k.scope = 'UNIT' JOIN ({OCCUPANCY}) o ON o.unit_id = r.unit_id AND r.timestamp BETWEEN o.since AND o.until
UNION ALL SELECT CASE k.scope WHEN 'COMMON' THEN 'common' ELSE 'building' END, NULL, NULL, k.building_id, r.* FROM {facts} r JOIN v_unit_meter k ON k.unit_id = r.unit_id AND k.scope <> 'UNIT'
WHERE r.timestamp <= TIMESTAMP '{THEN}' AND k.building_id IN ({LIVED_IN})"""


SCOPED = ("v_member", "v_household", "v_unit", "v_unit_meter")


@query("scoped_readings", f"""
SELECT scope, member_id, household_id, CAST(building_id AS BIGINT) AS building_id, unit_id, timestamp, meter_reading_kwh FROM ({in_scope_sql("v_unit_reading")}) q""", ("v_unit_reading", *SCOPED))
def _(t: Tables) -> DataFrame:
    return relations.scoped_readings(t("v_unit_reading"), *(t(v) for v in SCOPED), THEN).select(
        "scope", "member_id", "household_id", "building_id", "unit_id", "timestamp", "meter_reading_kwh"
    )


@query("scoped_incidents", f"""
SELECT scope, member_id, CAST(building_id AS BIGINT) AS building_id, id, timestamp, actual_kwh, severity, CAST(json_extract_string(snapshot, '$.predicted_kwh') AS DOUBLE) AS predicted_kwh,
  CAST(json_extract_string(snapshot, '$.delta_kwh') AS DOUBLE) AS delta_kwh, CAST(json_extract_string(snapshot, '$.estimated_waste_vnd') AS DOUBLE) AS estimated_waste_vnd FROM (
  SELECT *, row_number() OVER (PARTITION BY scope, member_id, CASE WHEN member_id IS NULL THEN building_id END ORDER BY timestamp DESC, id DESC) AS n FROM ({in_scope_sql("v_unit_incident")}) s) q WHERE n <= 100""", ("v_unit_incident", *SCOPED))
def _(t: Tables) -> DataFrame:
    return relations.scoped_incidents(t("v_unit_incident"), *(t(v) for v in SCOPED), THEN).select(
        "scope", "member_id", "building_id", "id", "timestamp", "actual_kwh", "severity", "predicted_kwh", "delta_kwh", "estimated_waste_vnd"
    )


@query("current_members", f"""
SELECT m.member_id, m.household_id, h.unit_id, CAST(u.building_id AS BIGINT) AS building_id FROM v_member m JOIN v_household h ON h.household_id = m.household_id JOIN v_unit u ON u.unit_id = h.unit_id
WHERE u.active AND m.starts_at <= TIMESTAMP '{THEN}' AND (m.ends_at IS NULL OR m.ends_at > TIMESTAMP '{THEN}') AND h.starts_at <= TIMESTAMP '{THEN}' AND (h.ends_at IS NULL OR h.ends_at > TIMESTAMP '{THEN}')""", ("v_member", "v_household", "v_unit"))
def _(t: Tables) -> DataFrame:
    return relations.current_members(t("v_member"), t("v_household"), t("v_unit"), THEN)


@query("ownership_violations", """
SELECT 'meter_unit_of_other_building' AS rule, 'm' || CAST(unit_id AS STRING) AS row_key FROM v_unit WHERE unit_id % 17 <> 0 AND unit_id % 11 = 0
UNION ALL SELECT 'meter_zone_mismatch', 'm' || CAST(unit_id AS STRING) FROM v_unit WHERE unit_id % 11 = 0 OR (unit_id % 13 = 0) <> (unit_id % 17 = 0)
UNION ALL SELECT 'reading_meter_mismatch', CAST(o_orderkey AS STRING) FROM orders WHERE (o_orderkey % 101 = 0) <> (o_custkey % 11 = 0)
UNION ALL SELECT 'scope_unit_check', 'm' || CAST(unit_id AS STRING) FROM v_unit WHERE unit_id % 17 = 0""", ("v_unit",))
def _(t: Tables) -> DataFrame:
    units = t("v_unit")
    u, b = F.col("unit_id"), F.col("building_id")
    meter, zone = F.concat(F.lit("m"), u.cast("string")), F.concat(F.lit("zu"), u.cast("string"))
    meters = units.select(
        meter.alias("meter_id"), zone.alias("zone_id"), F.lit("UNIT").alias("scope"),
        F.when(u % 11 == 0, b + 1).otherwise(b).alias("building_id"), F.when(u % 17 != 0, u).alias("unit_id"),
    )
    zones = units.select(zone.alias("zone_id"), "building_id", F.when(u % 13 != 0, u).alias("unit_id"))
    readings = t.base("orders").join(units, F.col("o_custkey") == F.col("unit_id")).select(
        F.col("o_orderkey").cast("string").alias("reading_id"), meter.alias("meter_id"), zone.alias("zone_id"),
        F.when(F.col("o_orderkey") % 101 == 0, b + 1).otherwise(b).alias("building_id"),
    )
    return relations.ownership_violations(meters, units, zones, readings)


KEPT = "SELECT * FROM v_household WHERE NOT (household_id % 3 <> 0 AND household_id % 40 <> 0 AND household_id % 90 <> 1)"
GONE = f"SELECT unit_id FROM v_unit WHERE unit_id % 2 = 0 AND unit_id NOT IN (SELECT unit_id FROM ({KEPT}) k)"


@query("cascade_survivors", f"""
SELECT tbl, unit_id, n FROM (
  SELECT 'households' AS tbl, unit_id, count(*) AS n FROM ({KEPT}) k GROUP BY 2
  UNION ALL SELECT 'units', unit_id, 1 FROM v_unit WHERE unit_id NOT IN ({GONE})
  UNION ALL SELECT 'readings', unit_id, count(*) FROM v_unit_reading WHERE unit_id NOT IN ({GONE}) GROUP BY 2
  UNION ALL SELECT 'events', unit_id, count(*) FROM v_unit_incident WHERE unit_id NOT IN ({GONE}) GROUP BY 2) z""", ("v_household", "v_unit", "v_unit_reading", "v_unit_incident"))
def _(t: Tables) -> DataFrame:
    h, u = F.col("household_id"), F.col("unit_id")
    units, households = t("v_unit"), t("v_household")
    meter = F.concat(F.lit("m"), u.cast("string"))
    tables = {
        "households": households.withColumn("is_seed", h % 3 != 0),
        "members": households.filter(h % 40 == 0).select("household_id"),
        "invitations": households.filter(h % 90 == 1).select("household_id"),
        "units": units.withColumn("is_seed", u % 2 == 0),
        "zones": units.select("unit_id", F.concat(F.lit("zu"), u.cast("string")).alias("zone_id")),
        "meters": units.select("unit_id", meter.alias("meter_id")),
        "readings": t("v_unit_reading").withColumn("meter_id", meter),
        "events": t("v_unit_incident").withColumn("meter_id", meter),
    }
    left = relations.cascade_survivors(tables)
    out = None
    for name in ("households", "units", "readings", "events"):
        part = left[name].groupBy(F.lit(name).alias("tbl"), "unit_id").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("unit_roster", """
SELECT u.unit_id, CAST(u.building_id AS BIGINT) AS building_id, coalesce(h.n, 0) AS households, CAST(coalesce(h.members, 0) AS BIGINT) AS members, CAST(coalesce(h.invitations, 0) AS BIGINT) AS invitations,
  CAST(CASE WHEN u.unit_id % 13 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS zones
FROM v_unit u LEFT JOIN (SELECT unit_id, count(*) AS n, count(*) AS members, count(*) FILTER (WHERE household_id % 9 = 0) AS invitations FROM v_household GROUP BY 1) h ON h.unit_id = u.unit_id
UNION ALL SELECT NULL, CAST(building_id AS BIGINT), 0, 0, 0, CAST(1 AS BIGINT) FROM v_unit WHERE unit_id % 13 = 0""", ("v_unit", "v_household"))
def _(t: Tables) -> DataFrame:
    units, households = t("v_unit"), t("v_household")
    h, u = F.col("household_id"), F.col("unit_id")
    invitations = households.filter((h % 9 == 0) | (h % 9 == 1)).select(
        (h * 10 + 7).alias("invitation_id"), "household_id", F.lit(None).cast("timestamp_ntz").alias("accepted_at"),
        F.when(h % 9 == 0, F.lit("2100-01-01 00:00:00")).otherwise(F.lit("1990-01-01 00:00:00")).cast("timestamp_ntz").alias("expires_at"),
    )
    zones = units.select(F.concat(F.lit("zu"), u.cast("string")).alias("zone_id"), "building_id", F.when(u % 13 != 0, u).alias("unit_id"))
    roster = relations.unit_roster(units, households, t("v_member"), invitations, zones, THEN)
    size = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0)))
    # the nested lists are counted, so that the twin can compare them
    counted = roster.select(
        "unit_id", "building_id", F.col("household_id").isNotNull().cast("int").alias("households"),
        size("members").alias("members"), size("invitations").alias("invitations"), size("zones").alias("zones"),
    )
    with_unit = counted.filter(u.isNotNull()).groupBy("unit_id", "building_id").agg(
        *[F.sum(c).alias(c) for c in ("households", "members", "invitations")], F.max("zones").alias("zones")
    )
    return with_unit.unionByName(counted.filter(u.isNull()))
