"""Timetable clocks beyond midnight, local time and service days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS, whose hours may exceed 23."""
    part = lambda n: F.split_part(text, F.lit(":"), F.lit(n)).cast("long")
    return part(1) * 3600 + part(2) * 60 + part(3)


def on_day(day: Column, seconds: Column) -> Column:
    """The local time so many seconds after a day's midnight, without zone shifts."""
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return day.cast("timestamp_ntz") + span


def local_time(utc: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def service_day(local: Column, scheduled_seconds: Column) -> Column:
    """The day whose timetable a local time belongs to.

    With a schedule: the day that brings the schedule nearest, so half a day is added before the
    date is taken. Without one: nights belong to the day before until 4 o'clock.
    """
    second = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(1).cast("decimal(18,6)"))
    back = F.coalesce(scheduled_seconds - 12 * 3600, F.lit(4 * 3600)).cast("int")
    return F.to_date(local - second * back)
