"""Event time as integer microseconds, so that windows and comparisons are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_us(ts: Column) -> Column:
    """Naive UTC timestamp to epoch microseconds (the session zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_us(us: Column) -> Column:
    """Epoch microseconds to a naive UTC timestamp."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def iso_z(ts: Column) -> Column:
    """ISO text with a Z suffix; the fraction is six digits, or absent when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", F.concat(whole, F.lit("Z"))).otherwise(
        F.concat(whole, F.lit("."), fraction, F.lit("Z")))


def iso_z_millis(ts: Column) -> Column:
    """ISO text cut to milliseconds with a Z suffix."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
