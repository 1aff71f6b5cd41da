"""Joins and expansions in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townlake.functions.clock import clock_seconds, on_day


def next_within(rows: DataFrame, ticks: DataFrame, key: list[str], at: str, tick_at: str, seconds: int) -> DataFrame:
    """Each row with the first tick of its key strictly later, if that is within ``seconds``.

    Rows without one are dropped. Rows and ticks are sorted together within their key and day
    buckets, so a key with many rows is sorted by parts: a row looks into its own bucket and a
    copy of the ticks of the next.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(seconds * 1_000_000 * 256))
    own = rows.withColumn("_bucket", bucket(at)).withColumn("_t", F.col(at)).withColumn("_tick", F.lit(None).cast(ticks.schema[tick_at].dataType))
    ticked = ticks.select(*key, F.col(tick_at).alias("_tick")).withColumn("_bucket", bucket("_tick"))
    copies = ticked.unionByName(ticked.withColumn("_bucket", F.col("_bucket") - 1)).withColumn("_t", F.col("_tick"))
    both = own.unionByName(copies, allowMissingColumns=True).withColumn("_is_row", F.col("_tick").isNull())
    # Among equal times a row comes after the ticks, which are not later than it.
    order = Window.partitionBy(*key, "_bucket").orderBy(F.col("_t").desc(), F.col("_is_row").desc())
    later = F.last("_tick", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))
    return (
        both.withColumn("next_at", later)
        .where("_is_row")
        .where(F.col("next_at") <= F.col(at) + span)
        .select(*rows.columns, "next_at")
    )


def expand_timetable(trips: DataFrame, calls: DataFrame, days: DataFrame) -> DataFrame:
    """Departures on the days asked for, from trips of those days and of the days before.

    ``trips`` has (trip_id, service_id), ``calls`` (trip_id, stop_id, stop_sequence,
    departure_time as text, hours may exceed 23), ``days`` (service_id, day). A trip's last call
    is no departure. Returns (day, trip_id, stop_id, departs_at) with departs_at on ``day``.
    """
    last = Window.partitionBy("trip_id").orderBy(F.col("stop_sequence").desc(), F.col("stop_id").desc())
    departures = calls.withColumn("_from_end", F.row_number().over(last)).where("_from_end > 1")
    asked = days.select("day").distinct()
    served = trips.join(days, "service_id").select("trip_id", F.col("day").alias("service_day"))
    placed = departures.join(served, "trip_id").withColumn(
        "departs_at", on_day(F.col("service_day"), clock_seconds(F.col("departure_time")))
    )
    return placed.withColumn("day", F.to_date("departs_at")).join(asked, "day", "left_semi").select(
        "day", "trip_id", "stop_id", "departs_at"
    )


def in_windows(rows: DataFrame, at: Column, windows: list[tuple[str, int, int]]) -> DataFrame:
    """Rows with the name of each window of the day, in seconds from midnight, that ``at`` is in."""
    second = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    named = F.array(*[F.when((second >= start) & (second < end), F.lit(name)) for name, start, end in windows])
    return rows.withColumn("window", F.explode(F.array_compact(named)))
