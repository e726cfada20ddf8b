"""Times as numbers, without a detour through the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_micros(value: Column) -> Column:
    """Microseconds from 1970-01-01 to a ``timestamp_ntz``, on the clock that it shows.

    The difference of two such times is an interval and knows no time zone; a
    cast to ``timestamp`` would, and isn't monotone where clocks are changed.
    """
    passed = value - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda field: F.date_part(F.lit(field), passed)
    whole = (part("DAY").cast("long") * 24 + part("HOUR").cast("long")) * 60 + part("MINUTE").cast("long")
    return whole * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")


def as_number(value: Column, kind: str) -> Column:
    """A column of the type named ``kind`` (``typeName``) as seconds, if it is a time, or as the number that it is; a double."""
    if kind == "timestamp_ntz":
        return local_micros(value) / 1_000_000
    return (value.cast("timestamp") if kind == "date" else value).cast("double")
