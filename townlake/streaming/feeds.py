"""Feeds that are fetched one by one: what each brought or why it failed is logged, and none stops another."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townlake.sources.publishing import single_flight

LOG = "feed string, fetched_at timestamp, feed_timestamp timestamp, duration_ms long, entities long, rows_written long, error string"


def _noted(spark: SparkSession, folder: str, row: dict) -> None:
    names = [f.name for f in spark.createDataFrame([], LOG).schema]
    spark.createDataFrame([tuple(row.get(n) for n in names)], LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def log_of(spark: SparkSession, folder: str) -> DataFrame:
    """All fetches so far, good and failed ones."""
    return spark.read.schema(LOG).parquet(f"{folder}/log")


def logged(spark: SparkSession, folder: str, feed: str, fetch: Callable[[], dict]) -> bool:
    """Run ``fetch`` and log what it returns (feed_timestamp, entities, rows_written), or its error; whether it was good."""
    began, at = time.monotonic(), datetime.now(timezone.utc)
    try:
        found, error = fetch(), None
    except Exception as failed:  # noqa: BLE001  whatever it is, it is this feed's own
        found, error = {}, f"{type(failed).__name__}: {str(failed).splitlines()[0] if str(failed) else ''}"
    _noted(spark, folder, found | {"feed": feed, "fetched_at": at, "duration_ms": round(1000 * (time.monotonic() - began)), "error": error})
    return error is None


def fetch_all(spark: SparkSession, folder: str, feeds: dict[str, Callable[[], dict]], lease_seconds: float = 600.0) -> dict[str, bool]:
    """Every feed once, one run at a time: ``Busy`` while another is under way. Which feeds were good."""
    with single_flight(spark, folder, "fetch", lease_seconds):
        return {feed: logged(spark, folder, feed, fetch) for feed, fetch in feeds.items()}


def batches_of(spark: SparkSession, folder: str, feed: str, write: Callable[[DataFrame], int]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that writes a batch and logs it; a failed batch is logged and then fails the stream."""

    def each(batch: DataFrame, batch_id: int) -> None:
        kept = {}

        def fetch() -> dict:
            kept["rows"] = write(batch)
            return {"entities": batch.count(), "rows_written": kept["rows"]}

        if not logged(spark, folder, feed, fetch):
            raise RuntimeError(f"batch {batch_id} of {feed} failed; the log has why")

    return each


def gaps(log: DataFrame, longest: str = "5 minutes") -> DataFrame:
    """(feed, gap_from, gap_to): times longer than ``longest`` without a good fetch of a feed, between two good ones."""
    good = log.where("error is null").groupBy("feed", F.date_trunc("day", "fetched_at").alias("day")).agg(F.array_sort(F.collect_list("fetched_at")).alias("times"))
    inner = good.select("feed", F.explode(F.zip_with(F.slice("times", 1, F.size("times") - 1), F.slice("times", 2, F.size("times")), lambda a, b: F.struct(a.alias("gap_from"), b.alias("gap_to")))).alias("g"))
    ends = good.select("feed", "day", F.array_min("times").alias("first"), F.array_max("times").alias("last"))
    # One row a feed and day: few, whatever the number of fetches.
    between = ends.selectExpr("feed", "lag(last) over (partition by feed order by day) as gap_from", "first as gap_to").where("gap_from is not null")
    return inner.select("feed", "g.*").unionByName(between).where(F.col("gap_to") - F.col("gap_from") > F.expr(f"interval {longest}"))
