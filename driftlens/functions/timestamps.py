"""ISO-8601 date-times written in several forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed format: extended (2016-01-05T20:31:22.5+02:00) or basic (20160105T203122Z); a blank may replace the T.
ISO_EXTENDED = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})[Tt ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)? ?([Zz]|[+\-][0-9]{2}(?::?[0-9]{2})?)?$"
ISO_BASIC = r"^([0-9]{4})([0-9]{2})([0-9]{2})[Tt ]([0-9]{2})([0-9]{2})(?:([0-9]{2})(?:[.,]([0-9]{1,9}))?)?([Zz]|[+\-][0-9]{2}(?::?[0-9]{2})?)?$"


def iso_instant(text: Column) -> Column:
    """The instant that an ISO-8601 date-time denotes, or null if it is none; without an offset it is UTC.

    Only written date-times count: a date alone, month 13 or hour 25 give null, while a valid but implausible
    date (1970-01-01) stays. The session's time zone has no influence.
    """
    clock, zone = _parts(text)
    return F.concat(clock, zone).try_cast("timestamp")


def iso_wall(text: Column) -> Column:
    """The date and time as written, whatever the offset."""
    return _parts(text)[0].try_cast("timestamp_ntz")


def _parts(text: Column) -> tuple[Column, Column]:
    t = F.trim(text)
    # Missing groups come out empty: seconds get a leading 0 that is cut again where two digits follow.
    flat = F.when(t.rlike(ISO_EXTENDED), F.regexp_replace(t, ISO_EXTENDED, "$1-$2-$3T$4:$5:0$6.0$7|$8")).when(
        t.rlike(ISO_BASIC), F.regexp_replace(t, ISO_BASIC, "$1-$2-$3T$4:$5:0$6.0$7|$8")
    )
    clock = F.regexp_replace(F.substring_index(flat, "|", 1), r":0([0-9]{2})\.", ":$1.")
    clock = F.regexp_replace(clock, r"\.0([0-9])", ".$1")
    offset = F.regexp_replace(F.upper(F.substring_index(flat, "|", -1)), r"^([+\-][0-9]{2}):?([0-9]{2})$", "$1:$2")
    zone = F.when(offset == "", "Z").when(F.length(offset) == 3, F.concat(offset, F.lit(":00"))).otherwise(offset)
    return clock, zone


def micros(instant: Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(instant)
