"""Time helpers that do not depend on the session time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts)


def bucket(ts: Column, g: int) -> Column:
    """Start of the g-second bucket, aligned to the epoch."""
    s = F.unix_seconds(ts)
    return F.timestamp_seconds(s - F.pmod(s, F.lit(g)))


def _local_hours(ts: Column, tz: str) -> Column:
    # from_utc_timestamp shifts the instant by the zone's offset, so the shifted epoch is local time
    return F.floor(F.unix_seconds(F.from_utc_timestamp(ts, tz)) / 3600).cast("long")


def hour_of_day(ts: Column, tz: str = "UTC") -> Column:
    return F.pmod(_local_hours(ts, tz), F.lit(24)).cast("int")


def hour_of_week(ts: Column, tz: str = "UTC") -> Column:
    """0..167 with Monday 00h = 0; the epoch began on a Thursday, 72 hours into its week."""
    return F.pmod(_local_hours(ts, tz) + 72, F.lit(168)).cast("int")
