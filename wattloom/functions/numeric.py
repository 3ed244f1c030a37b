"""Rounding and time arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A nudge far below any reported digit: a tie falls the same way, whatever the
# order in which the engine added the doubles.
NUDGE = 1e-9
RELATIVE_NUDGE = 1.000000000001


def half_up(value: Column, digits: int) -> Column:
    return F.round(value * F.lit(RELATIVE_NUDGE) + F.lit(NUDGE), digits)


def fixed(value: Column, digits: int) -> Column:
    """Text with exactly ``digits`` decimals, '.' as the separator."""
    return F.format_string(f"%.{digits}f", half_up(value, digits))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 as a long."""
    return F.unix_micros(ts.cast("timestamp"))


def elapsed(later: Column, earlier: Column) -> Column:
    """Seconds between two times; whole microseconds are subtracted first."""
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def trunc_ntz(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def hours_after(ts: Column, hours) -> Column:
    """``ts`` moved by a number (or a column) of hours, zone-free."""
    amount = hours if isinstance(hours, Column) else F.lit(hours)
    return ts + F.make_dt_interval(F.lit(0), amount.cast("int"))


def sql_round(expression: str, digits: int) -> str:
    """The SQL twin of :func:`half_up`."""
    return f"round(({expression}) * CAST({RELATIVE_NUDGE!r} AS DOUBLE) + 1e-9, {digits})"
