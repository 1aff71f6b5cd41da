"""Live-feed semantics over events: users are vehicles, types stops, values predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townlake.plans.tables import table
from townlake.streaming.live import first_and_last, latest_reports, new_reports, passed


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("vehicle_id"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("recorded_at"),
        F.col("event_type").alias("status"), F.col("event_id").alias("report"),
    )


def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports, delivered twice, that those of even events have not stored, by day; each key once."""
    reports = _reports(spark, sf_dir)
    added = new_reports(reports.unionByName(reports), reports.where("report % 2 = 0").select("vehicle_id", "recorded_at"))
    return added.groupBy(F.date_format("recorded_date", "yyyyMMdd").alias("day")).agg(F.count("*").alias("n"))


def stored_reports_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of odd events that those of even events have not stored, by day; each key once."""
    reports = _reports(spark, sf_dir)
    added = new_reports(reports.where("report % 2 = 1"), reports.where("report % 2 = 0").select("vehicle_id", "recorded_at"))
    return added.groupBy(F.date_format("recorded_date", "yyyyMMdd").alias("day")).agg(F.count("*").alias("n"))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.col("ts").cast("timestamp")
    seconds = lambda s: F.timestamp_seconds(F.unix_seconds(seen) + s)
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("service_date"), (F.col("user_id") % 50).cast("string").alias("trip_id"), F.col("event_type").alias("stop_id"),
        F.date_trunc("second", seen).alias("seen_at"), seconds(F.round(F.col("value")).cast("long") % 300).alias("predicted"),
        seconds(F.lit(-60)).alias("scheduled"),
    )


def prediction_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last predictions of each trip, stop and day, in epoch seconds."""
    state = first_and_last(_arrivals(spark, sf_dir), ["scheduled"])
    second = lambda c: F.unix_seconds(c).alias(c)
    return state.select(
        F.date_format("service_date", "yyyyMMdd").alias("day"), "trip_id", "stop_id", second("scheduled"), second("first_seen"), second("first_predicted"),
        second("last_seen"), second("last_predicted"), "updates",
    )


def passed_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips that passed a stop, with delays; every tenth event is a fetch, some of them failed."""
    fetches = table(spark, sf_dir, "events").where("event_id % 10 = 0").select(
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("fetched_at"), F.when(F.col("event_id") % 70 == 0, "timeout").alias("error")
    )
    gone = passed(first_and_last(_arrivals(spark, sf_dir), ["scheduled"]), fetches)
    return gone.select(F.date_format("service_date", "yyyyMMdd").alias("day"), "trip_id", "stop_id", F.col("delay_s").cast("long").alias("delay_s"))


def vehicles_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest report of each vehicle around a moment of the feed."""
    near = latest_reports(_reports(spark, sf_dir), "2024-01-15 12:00:00", 6 * 3600, 3600)
    return near.select("vehicle_id", F.unix_seconds("recorded_at").alias("recorded_s"))


QUERIES = {f.__name__: f for f in (stored_reports, stored_reports_all, prediction_states, passed_stops, vehicles_now)}

_ARRIVALS = """a AS (SELECT strftime(CAST(ts AS DATE), '%Y%m%d') AS day, CAST(user_id % 50 AS VARCHAR) AS trip_id, event_type AS stop_id,
  CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seen, CAST(epoch(date_trunc('second', ts)) AS BIGINT) + CAST(round(value) AS BIGINT) % 300 AS predicted FROM events),
s AS (SELECT day, trip_id, stop_id, arg_min(seen, struct_pack(seen, predicted)) - 60 AS scheduled, min(seen) AS first_seen,
  arg_min(predicted, struct_pack(seen, predicted)) AS first_predicted, max(seen) AS last_seen, arg_max(predicted, struct_pack(seen, predicted)) AS last_predicted, count(*) AS updates
  FROM a GROUP BY ALL)"""

ORACLES = {
    "stored_reports": """WITH r AS (SELECT user_id, date_trunc('minute', ts) AS m, event_id FROM events)
SELECT strftime(m, '%Y%m%d') AS day, count(*) AS n FROM (SELECT DISTINCT user_id, m FROM r) x
WHERE NOT EXISTS (SELECT 1 FROM r WHERE event_id % 2 = 0 AND r.user_id = x.user_id AND r.m = x.m) GROUP BY 1""",
    "stored_reports_all": """WITH r AS (SELECT user_id, date_trunc('minute', ts) AS m, event_id FROM events)
SELECT strftime(m, '%Y%m%d') AS day, count(*) AS n FROM (SELECT DISTINCT user_id, m FROM r WHERE event_id % 2 = 1) x
WHERE NOT EXISTS (SELECT 1 FROM r WHERE event_id % 2 = 0 AND r.user_id = x.user_id AND r.m = x.m) GROUP BY 1""",
    "prediction_states": f"WITH {_ARRIVALS} SELECT * FROM s",
    "passed_stops": f"""WITH {_ARRIVALS}, f AS (SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t FROM events WHERE event_id % 10 = 0 AND event_id % 70 <> 0),
n AS (SELECT s.*, (SELECT min(t) FROM f WHERE t > last_seen) AS t FROM s)
SELECT day, trip_id, stop_id, last_predicted - scheduled AS delay_s FROM n WHERE t <= last_seen + 120 AND last_predicted <= t + 60""",
    "vehicles_now": """SELECT 'v' || user_id AS vehicle_id, CAST(epoch(max(m)) AS BIGINT) AS recorded_s FROM (SELECT user_id, date_trunc('minute', ts) AS m FROM events)
WHERE m > TIMESTAMP '2024-01-15 06:00:00' AND m <= TIMESTAMP '2024-01-15 13:00:00' GROUP BY user_id""",
}
