"""A timetable made of orders: trips are orders, calls their items, stops the suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townlake.functions.clock import local_time, service_day
from townlake.operators.reach import events_in_reach
from townlake.operators.temporal import expand_timetable, in_windows
from townlake.plans.tables import (
    BUILDINGS_SQL,
    FACILITIES_SQL,
    buildings,
    facilities,
    metres_sql,
    table,
)

#: Windows of the day in seconds from midnight.
WINDOWS = [("morning", 6 * 3600, 9 * 3600), ("day", 9 * 3600, 17 * 3600), ("night", 0, 5 * 3600)]


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = (F.col("l_orderkey") * 97 + F.col("l_linenumber") * 1300) % 97200
    part = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    clock = F.concat_ws(":", part(F.floor(seconds / 3600)), part(F.floor(seconds / 60) % 60), part(seconds % 60))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("stop_id"), F.col("l_linenumber").alias("stop_sequence"), clock.alias("departure_time")
    )


def _departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip_id"), (F.col("o_orderkey") % 3).alias("service_id"))
    days = spark.createDataFrame([(0, "2024-03-04"), (0, "2024-03-05"), (1, "2024-03-05"), (1, "2024-03-03")], "service_id long, day string")
    return expand_timetable(trips, _calls(spark, sf_dir), days.select("service_id", F.to_date("day").alias("day")))


def stop_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures by stop, day and hour, after-midnight calls on the day that they happen."""
    return _departures(spark, sf_dir).groupBy(
        "stop_id", F.date_format("day", "yyyyMMdd").alias("day"), F.hour("departs_at").cast("long").alias("hour")
    ).agg(F.count("*").alias("departures"))


def window_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures and trips by named window of the day."""
    named = in_windows(_departures(spark, sf_dir), F.col("departs_at"), WINDOWS)
    return named.groupBy("window", F.date_format("day", "yyyyMMdd").alias("day")).agg(
        F.count("*").alias("departures"), F.countDistinct("trip_id").alias("trips")
    )


def trips_near_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips that call within 1.5 km of each building, each trip once however many stops it has there."""
    homes, stops = buildings(spark, sf_dir).select("c_custkey", "lon", "lat"), facilities(spark, sf_dir).select(F.col("s_suppkey").alias("stop_id"), "lon", "lat")
    trips, _ = events_in_reach(homes, stops, _calls(spark, sf_dir), "c_custkey", "stop_id", "trip_id", 1500.0)
    return trips.withColumnRenamed("events", "trips")


def service_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service days of events as sightings of trips: with a schedule for even users, without for odd."""
    local = local_time(F.col("ts"), "Europe/Berlin")
    scheduled = F.when(F.col("user_id") % 2 == 0, (F.col("event_id") * 37) % 97200)
    day = service_day(local, scheduled)
    return table(spark, sf_dir, "events").groupBy(F.date_format(day, "yyyyMMdd").alias("day")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stop_hours, window_departures, trips_near_buildings, service_days)}

_DEPARTURES = """calls AS (
  SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, (l_orderkey * 97 + l_linenumber * 1300) % 97200 AS s,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_suppkey DESC) AS from_end FROM lineitem
), days(service_id, day) AS (VALUES (0, DATE '2024-03-04'), (0, DATE '2024-03-05'), (1, DATE '2024-03-05'), (1, DATE '2024-03-03')),
dep AS (SELECT trip_id, stop_id, day + to_seconds(s) AS leaves FROM calls JOIN days ON trip_id % 3 = service_id WHERE from_end > 1),
d AS (SELECT *, CAST(leaves AS DATE) AS day FROM dep WHERE CAST(leaves AS DATE) IN (SELECT day FROM days))"""

ORACLES = {
    "stop_hours": f"WITH {_DEPARTURES} SELECT stop_id, strftime(day, '%Y%m%d') AS day, hour(leaves) AS hour, count(*) AS departures FROM d GROUP BY ALL",
    "window_departures": f"""WITH {_DEPARTURES}, w(name, a, b) AS (VALUES ('morning', 21600, 32400), ('day', 32400, 61200), ('night', 0, 18000))
SELECT name AS "window", strftime(day, '%Y%m%d') AS day, count(*) AS departures, count(DISTINCT trip_id) AS trips
FROM d JOIN w ON hour(leaves) * 3600 + minute(leaves) * 60 + second(leaves) >= a AND hour(leaves) * 3600 + minute(leaves) * 60 + second(leaves) < b GROUP BY ALL""",
    "trips_near_buildings": f"""WITH {BUILDINGS_SQL}, {FACILITIES_SQL}, p AS (SELECT c_custkey, s_suppkey FROM buildings b, facilities f WHERE {metres_sql('b', 'f')} <= 1500)
SELECT c_custkey, count(DISTINCT l_orderkey) AS trips FROM p JOIN lineitem ON l_suppkey = s_suppkey GROUP BY c_custkey""",
    "service_days": """WITH e AS (SELECT ts + INTERVAL 1 HOUR AS local, CASE WHEN user_id % 2 = 0 THEN event_id * 37 % 97200 - 43200 ELSE 14400 END AS back FROM events)
SELECT strftime(CAST(local - to_seconds(back) AS DATE), '%Y%m%d') AS day, count(*) AS n FROM e GROUP BY 1""",
}
