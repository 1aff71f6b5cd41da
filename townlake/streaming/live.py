"""Live feeds: vehicle reports kept once, first and last predictions, passed stops."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from townlake.functions.clock import on_day, service_day
from townlake.operators.checkpoints import durable
from townlake.operators.tables import first_per_key
from townlake.operators.temporal import next_within

REPORT_KEY = ["vehicle_id", "recorded_at"]
ARRIVAL_KEY = ["service_date", "trip_id", "stop_id"]
#: A good fetch this soon after the last sighting shows that the stop really left the feed.
GAP_SECONDS = 120
#: The last prediction may lie this far beyond that fetch.
SLACK_SECONDS = 60


def new_reports(reports: DataFrame, stored: DataFrame) -> DataFrame:
    """Reports whose vehicle and time are not stored yet, each once, with their UTC day."""
    once = first_per_key(reports, REPORT_KEY, [F.col(c).asc_nulls_last() for c in reports.columns if c not in REPORT_KEY])
    return once.join(stored.select(*REPORT_KEY), REPORT_KEY, "left_anti").withColumn("recorded_date", F.to_date("recorded_at"))


def stored_or(empty: DataFrame, spark: SparkSession, table: str) -> DataFrame:
    """The Parquet ``table``, or ``empty`` as long as nothing is stored."""
    try:
        return spark.read.schema(empty.schema).parquet(table)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty


def write_reports(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each report once to the Parquet ``table``, by UTC day.

    A micro-batch is held against the days that it touches only, however late a report is. A
    batch that is retried finds its own rows there and adds none.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumn("recorded_date", F.to_date("recorded_at")).persist()
        days = [r["recorded_date"] for r in dated.select("recorded_date").distinct().collect()]
        stored = stored_or(dated.limit(0), spark, table).where(F.col("recorded_date").isin(days))
        new_reports(dated.drop("recorded_date"), stored).write.mode("append").partitionBy("recorded_date").parquet(table)
        dated.unpersist()

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_and_last(arrivals: DataFrame, schedule_columns: list[str]) -> DataFrame:
    """Predictions folded by trip, stop and service day, in the order of fetches.

    The first sighting gives first_predicted, first_seen and the schedule columns, which later
    ones never change; the last gives last_predicted and last_seen; ``updates`` counts all.
    """
    order = F.struct("seen_at", "predicted")
    return arrivals.groupBy(*ARRIVAL_KEY).agg(
        *[F.min_by(c, order).alias(c) for c in schedule_columns],
        F.min_by("predicted", order).alias("first_predicted"),
        F.min("seen_at").alias("first_seen"),
        F.max_by("predicted", order).alias("last_predicted"),
        F.max("seen_at").alias("last_seen"),
        F.count("*").alias("updates"),
    )


def folded(stored: DataFrame, batch: DataFrame, batch_id: int, schedule_columns: list[str]) -> DataFrame:
    """``stored`` states after one more batch of sightings, in the form of ``first_and_last``.

    What a key had first stays, what comes now is last: batches count in the order in which they
    arrive, however late their times are. A state that this batch has changed already, before a
    retry, stays as it is.
    """
    new = first_and_last(batch, schedule_columns)
    both = new.alias("n").join(stored.alias("s"), ARRIVAL_KEY, "full_outer")
    known = F.col("s.updates").isNotNull()
    done = F.col("n.updates").isNull() | (known & (F.col("s.batch") >= batch_id))
    kept = [*schedule_columns, "first_predicted", "first_seen"]
    return both.select(
        *ARRIVAL_KEY,
        *[F.when(known, F.col(f"s.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in kept],
        *[F.when(done, F.col(f"s.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in ("last_predicted", "last_seen")],
        F.when(done, F.col("s.updates")).otherwise(F.coalesce("s.updates", F.lit(0)) + F.col("n.updates")).alias("updates"),
        F.when(done, F.col("s.batch")).otherwise(F.lit(batch_id)).cast("long").alias("batch"),
    )


def follow_arrivals(stream: DataFrame, table: str, checkpoint: str, schedule_columns: list[str], trigger: dict | None = None) -> StreamingQuery:
    """Keep ``first_and_last`` of all sightings in the Parquet ``table``, by service day.

    A micro-batch reads and replaces the days that it touches only. No sighting is ever too late.
    ``trigger`` is that of the stream, once over what is there by default.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        days = [r["service_date"] for r in batch.select("service_date").distinct().collect()]
        shape = first_and_last(batch.limit(0), schedule_columns).withColumn("batch", F.lit(0).cast("long"))
        stored = stored_or(shape, spark, table).where(F.col("service_date").isin(days))
        after = durable(folded(stored.select(*shape.columns), batch, batch_id, schedule_columns))
        after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("service_date").parquet(table)
        batch.unpersist()

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def with_schedule(arrivals: DataFrame, timetable: DataFrame, zone: str) -> DataFrame:
    """Sightings with the timetable's time of their trip and stop, and the service day that it gives.

    ``timetable`` has (trip_id, stop_id, seconds). A static side: joined to a stream or a table.
    Unknown trips have no schedule, and nights count to the day before. The earliest call of a trip at a stop is taken.
    """
    calls = timetable.groupBy("trip_id", "stop_id").agg(F.min("seconds").alias("seconds"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("predicted").cast("timestamp_ntz"))
    joined = arrivals.join(calls, ["trip_id", "stop_id"], "left").withColumn("service_date", service_day(local, F.col("seconds")))
    due = F.convert_timezone(F.lit(zone), F.lit("UTC"), on_day(F.col("service_date"), F.col("seconds")))
    return joined.withColumn("scheduled", due.cast("timestamp")).drop("seconds")


def usable_updates(updates: DataFrame) -> DataFrame:
    """Stop updates that predict an arrival: none that is deleted, of a cancelled trip, skipped or without a time.

    ``updates`` has deleted, trip_status, stop_status, arrival and departure; the arrival counts
    before the departure.
    """
    fit = (
        ~F.coalesce("deleted", F.lit(False))
        & ~F.coalesce(F.col("trip_status") == "CANCELED", F.lit(False))
        & ~F.coalesce(F.col("stop_status").isin("SKIPPED", "NO_DATA"), F.lit(False))
    )
    return updates.where(fit).withColumn("predicted", F.coalesce("arrival", "departure")).where("predicted is not null").drop("deleted", "trip_status", "stop_status", "arrival", "departure")


def passed(arrivals: DataFrame, fetches: DataFrame) -> DataFrame:
    """Arrivals that left the feed because the vehicle passed, with ``delay_s``.

    The next good fetch after the last sighting must come within GAP_SECONDS, and the last
    prediction at most SLACK_SECONDS after it; otherwise the feed had a gap, or the vehicle is
    still on its way.
    """
    good = fetches.where("error is null").select("fetched_at").withColumn("feed", F.lit(1))
    followed = next_within(arrivals.withColumn("feed", F.lit(1)), good, ["feed"], "last_seen", "fetched_at", GAP_SECONDS)
    ahead = F.unix_seconds("last_predicted") - F.unix_seconds("next_at")
    return (
        followed.where(ahead <= SLACK_SECONDS)
        .withColumn("delay_s", (F.unix_seconds("last_predicted") - F.unix_seconds("scheduled")).cast("int"))
        .drop("feed", "next_at")
    )


def latest_reports(reports: DataFrame, fetched_at, before_s: int = 180, after_s: int = 60) -> DataFrame:
    """The newest report of each vehicle around the last good fetch."""
    apart = F.unix_seconds("recorded_at") - F.unix_seconds(F.lit(fetched_at).cast("timestamp"))
    near = reports.where((apart > -before_s) & (apart <= after_s))
    return first_per_key(near, ["vehicle_id"], [F.col("recorded_at").desc()])


def last_good_fetch(fetches: DataFrame) -> DataFrame:
    """One row, (fetched_at): the time of the last fetch without an error; null if there is none."""
    return fetches.where("error is null").agg(F.max("fetched_at").alias("fetched_at"))


def vehicles_with_delay(reports: DataFrame, arrivals: DataFrame, fetches: DataFrame, before_s: int = 180, after_s: int = 60) -> DataFrame:
    """The newest report of each vehicle around the last good fetch, with the delay of its trip.

    The delay is that of the trip's stop that was seen last, then predicted first.
    """
    at = F.broadcast(last_good_fetch(fetches))  # one row
    apart = F.unix_seconds("recorded_at") - F.unix_seconds("fetched_at")
    near = reports.crossJoin(at).where((apart > -before_s) & (apart <= after_s)).drop("fetched_at")
    newest = first_per_key(near, ["vehicle_id"], [F.col("recorded_at").desc(), *[F.col(c).asc_nulls_last() for c in reports.columns if c not in REPORT_KEY]])
    known = arrivals.where("scheduled is not null")
    delay = (F.unix_seconds("last_predicted") - F.unix_seconds("scheduled")).cast("long")
    late = known.groupBy("trip_id").agg(F.max_by(delay, F.struct("last_seen", (-F.unix_seconds("last_predicted")).alias("sooner"), "stop_id")).alias("delay_s"))
    return newest.join(late, "trip_id", "left")
