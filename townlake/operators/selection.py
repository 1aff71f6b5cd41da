"""Exact percentiles of groups of any size, by counting instead of sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townlake.operators.checkpoints import durable

#: Values up to which a group is a task's own business; larger ones are counted in BINS ranges, round by round.
AT_ONCE, BINS = 100_000, 1024


def _narrowed(facts: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    """``targets`` (group, target, rank, low, high) cut down to the range of BINS that holds their rank."""
    met = facts.join(F.broadcast(targets), group).where(F.col("_v").between(F.col("low"), F.col("high")))
    # Halves, so that no difference of two values is infinite.
    place = (F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    binned = met.withColumn("_bin", F.least(F.lit(BINS - 1), F.floor(place * BINS)).cast("int"))
    counts = binned.groupBy(*group, "target", "rank", "_bin").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    upto = F.sum("n").over(Window.partitionBy(*group, "target").orderBy("_bin"))
    holds = counts.withColumn("_upto", upto).where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("n")))
    return holds.select(*group, "target", (F.col("rank") - F.col("_upto") + F.col("n")).alias("rank"), "low", "high")


def exact_percentiles(rows: DataFrame, keys: list[str], values: dict[str, Column], share: float = 0.5, at_once: int = AT_ONCE) -> DataFrame:
    """``keys`` and, for each name of ``values``, the percentile at ``share``, between the two values beside it.

    Groups of at most ``at_once`` values take Spark's own function. A larger group's range is cut into
    BINS parts, whose values every task counts for itself; the part that holds the wanted rank is cut
    again, until one value is left. So no task holds a group, and a round moves at most BINS rows a task
    and group. There is at most one large group for each ``at_once`` rows: their ranges are broadcast.
    Nulls and NaN do not count; a group without values has null; keys may be null.
    """
    names = list(values)
    kept = [F.struct(F.col(k).isNull().alias("none"), F.col(k).alias("key")).alias(f"_k{i}") for i, k in enumerate(keys)]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), values[name].cast("double").alias("v")) for name in names]))
    facts = rows.select(*kept, each.alias("_e")).select(*[f"_k{i}" for i in range(len(keys))], F.col("_e.name").alias("_name"), F.when(~F.isnan("_e.v"), F.col("_e.v")).alias("_v"))
    group = [*[f"_k{i}" for i in range(len(keys))], "_name"]
    sizes = durable(facts.groupBy(*group).agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")))
    large, at = sizes.where(F.col("n") > at_once), (F.col("n") - 1) * F.lit(float(share))
    small = facts.join(F.broadcast(large.select(*group)), group, "left_anti").groupBy(*group).agg(F.percentile("_v", share).alias("value"))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("target"), rank.cast("long").alias("rank")) for name, rank in (("lower", F.floor(at)), ("upper", F.ceil(at)))]))
    open_, done = durable(large.withColumn("_r", ranks).select(*group, "_r.target", "_r.rank", "low", "high")), None
    if not open_.isEmpty():
        facts = durable(facts.join(F.broadcast(large.select(*group)), group))
    while not open_.isEmpty():
        closed = open_.where("low = high")
        done = closed if done is None else done.unionByName(closed)
        left = open_.where("low < high")
        open_ = durable(_narrowed(facts, left, group)) if not left.isEmpty() else left
    if done is not None:
        of = lambda target: F.max(F.when(F.col("target") == target, F.col("low")))
        ends = done.groupBy(*group).agg(of("lower").alias("lower"), of("upper").alias("upper")).join(sizes.select(*group, "n"), group)
        between = F.col("lower") + (F.col("upper") - F.col("lower")) * (at - F.floor(at))
        small = small.unionByName(ends.select(*group, between.alias("value")))
    wide = small.groupBy(*group[:-1]).agg(*[F.max(F.when(F.col("_name") == name, F.col("value"))).alias(name) for name in names])
    return wide.select(*[F.col(f"_k{i}.key").alias(k) for i, k in enumerate(keys)], *names)
