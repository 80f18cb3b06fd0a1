"""Time arithmetic on TIMESTAMP_NTZ columns.

All helpers work in integer microseconds since the epoch so the result
never depends on the session time zone and needs no floating point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatecast.schemas import SLOT_MINUTES, BASELINE_LEAD_MINUTES

US_PER_MINUTE = 60_000_000
SLOT_US = SLOT_MINUTES * US_PER_MINUTE


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 for an NTZ timestamp (bigint)."""
    return F.timestamp_diff("MICROSECOND", _epoch(), _c(ts))


def add_us(ts: Column | str, us: Column | int) -> Column:
    return F.timestamp_add("MICROSECOND", us if isinstance(us, Column) else F.lit(us), _c(ts))


def add_minutes(ts: Column | str, minutes: int | Column) -> Column:
    """Ts + n minutes (n may be negative or a column)."""
    n = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return F.timestamp_add("MINUTE", n, _c(ts))


def ceil_slot(ts: Column | str, slot_us: int = SLOT_US) -> Column:
    """Round up to the next slot boundary (unchanged when on one).

    Nearest-slot rounding followed by a one-slot bump whenever the rounded
    value is below the original equals a ceiling, whatever the tie rule.
    """
    return add_us(ts, F.pmod(-epoch_us(ts), F.lit(slot_us)))


def floor_slot(ts: Column | str, slot_us: int = SLOT_US) -> Column:
    return add_us(ts, -F.pmod(epoch_us(ts), F.lit(slot_us)))


def round_slot_half_even(ts: Column | str, slot_us: int = SLOT_US) -> Column:
    """D3: round to the nearest slot; exact halves go to the even slot."""
    us = epoch_us(ts)
    rem = F.pmod(us, F.lit(slot_us))
    down = us - rem
    half = slot_us // 2
    slot_index_odd = F.pmod(F.floor(down / F.lit(slot_us)), F.lit(2)) == 1
    up = (rem > half) | ((rem == half) & slot_index_odd)
    return add_us(_epoch(), F.when(up, down + F.lit(slot_us)).otherwise(down))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Fractional minutes from start to end (double, exact integer numerator)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(float(US_PER_MINUTE))


def baseline_minutes(ts: Column | str, departure: Column | str) -> Column:
    """Minutes from ts to (estimated departure less the taxi lead)."""
    lead_us = BASELINE_LEAD_MINUTES * US_PER_MINUTE
    return (F.timestamp_diff("MICROSECOND", _c(ts), _c(departure)) - F.lit(lead_us)) / F.lit(
        float(US_PER_MINUTE))


def day_name(ts: Column | str) -> Column:
    """Full English weekday name."""
    return F.date_format(_c(ts), "EEEE")


def month_name(ts: Column | str) -> Column:
    """Full English month name."""
    return F.date_format(_c(ts), "MMMM")


def coerce_timestamp(col: Column | str) -> Column:
    """Text (or timestamp) to TIMESTAMP_NTZ; malformed text fails under ANSI."""
    return F.to_timestamp_ntz(_c(col).cast("string"))
