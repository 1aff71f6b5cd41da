"""What the training-data operators share: text columns, durable tables, running sums."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townlake.operators.checkpoints import durable, shared_folder

__all__ = ["SPACES", "WORD", "durable", "give_back_memory", "lower_ascii", "running_sums", "session", "shared_folder", "stored", "text_or_empty", "without_spaces"]

#: The white space that separates words, as characters and as the pattern of a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    path = f"{shared_folder(session(df))}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return session(df).read.parquet(path)


def give_back_memory() -> None:
    """Return to the system what a Python worker no longer uses: the tasks of earlier stages ran in the same process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def without_spaces(text: Column) -> Column:
    """Delete every white-space character of ``SPACES``."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does the same, faster, where all characters are ASCII."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, capitals, capitals.lower()))


def running_sums(
    rows: DataFrame, group: Sequence[str], value: str, key: str, ties: Sequence[str], digits: int = 3
) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the same group with a smaller ``key``.

    ``key`` is a random hexadecimal string. Its first ``digits`` digits cut each group into key
    ranges of about equal size; sums of whole ranges are added up over a table of at most
    16**digits rows a group, and only the rows of one range are sorted together, so no task gets
    a whole group. Rows with equal keys are ordered by ``ties``. Groups must not be null.
    """
    ranged = rows.withColumn("_range", F.substring(key, 1, digits))
    totals = ranged.groupBy(*group, "_range").agg(F.sum(value).alias("_total"))
    ranges_before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *group, "_range", F.coalesce(F.sum("_total").over(ranges_before), F.lit(0)).alias("_start")
    )
    rows_before = (
        Window.partitionBy(*group, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    )
    within = F.coalesce(F.sum(value).over(rows_before), F.lit(0))
    return (
        ranged.join(starts, [*group, "_range"])
        .withColumn("before", F.col("_start") + within)
        .drop("_range", "_start")
    )
