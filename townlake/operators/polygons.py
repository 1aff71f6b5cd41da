"""Polygons as results: what pairs share, proper shapes of improper ones, and shapes of whole groups."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townlake.functions.arrangement import PIECES, _frame, _split, arranged, both, either, pieces_of, repaired, rings_of, shape_of_two, valid
from townlake.operators.checkpoints import durable
from townlake.operators.overlay import bounded
from townlake.operators.spatial import box_overlaps

#: Shapes that are united at once, at most about.
TOGETHER = 64
#: Bits of a cell's number along one axis, and those that a round of uniting takes away.
CELL_BITS, ROUND_BITS = 15, 3


def intersections(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell_size: float = 0.05) -> DataFrame:
    """(left_id, right_id, rings): the ground that two polygons share, with its parts and holes.

    Candidates are those whose bounds overlap, found by grid cells of ``cell_size`` degrees. Polygons
    that only touch have no row. The names of the ids must differ.
    """
    pairs = box_overlaps(bounded(left, left_id), bounded(right, right_id), cell_size)
    made = pairs.withColumn("_pieces", shape_of_two(F.col("rings_l"), F.col("rings_r"), both)).where(F.size("_pieces.sizes") > 0)
    return made.select(F.col("key_l").alias(left_id), F.col("key_r").alias(right_id), rings_of(F.col("_pieces")).alias("rings"))


def once_per_shape(rows: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``made`` adds to (shape), the distinct ones of their ``rings``, dealt out to all tasks."""
    shapes = rows.select(F.col("rings").alias("shape")).distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = made(shapes).withColumnRenamed("shape", "_of")
    return rows.join(found, F.col("rings").eqNullSafe(F.col("_of"))).drop("_of")


def with_proper_rings(rows: DataFrame) -> DataFrame:
    """``rows`` with ``was_valid``, and with ``rings`` mended where they were not proper; null rings become none.

    Rows with equal rings share the work.
    """
    none = F.array().cast("array<array<struct<x: double, y: double>>>")

    def mended(shapes: DataFrame) -> DataFrame:
        judged = shapes.withColumn("was_valid", valid(F.col("shape"))).withColumn("_pieces", F.coalesce("shape", none))
        judged = judged.withColumn("_pieces", repaired(F.when(F.col("was_valid"), none).otherwise(F.col("_pieces"))))
        return judged.select("shape", "was_valid", F.when(F.col("was_valid"), F.col("shape")).otherwise(rings_of(F.col("_pieces"))).alias("_mended"))

    return once_per_shape(rows, mended).withColumn("rings", F.col("_mended")).drop("_mended")


def _place(low: Column, high: Column, reach: float) -> Column:
    return F.least(F.lit((1 << CELL_BITS) - 1), F.greatest(F.lit(0), F.floor(((low + high) / 2 + reach) / (2 * reach) * (1 << CELL_BITS)))).cast("long")


def dissolved(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each value of ``keys`` with the ``rings`` of the union of its rows' shapes.

    Shapes near each other are united first, by cells that grow eightfold each way from round to
    round; what lies inside a union is gone before the next. A cell with many shapes unites them in
    parts, so no task holds a group, only the outlines of a few parts of it. Keys may be null.
    """
    x, y, n = pieces_of(F.col("rings"))
    shape = F.struct(x.alias("xs"), y.alias("ys"), n.alias("sizes"))
    bounds = lambda name: (F.array_min(F.col(f"shape.{name}")), F.array_max(F.col(f"shape.{name}")))
    at = {"_cx": _place(*bounds("xs"), 180.0), "_cy": _place(*bounds("ys"), 90.0)}
    state = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], shape.alias("shape")).where(F.size("shape.sizes") > 0).withColumns(at)
    names = [f"_k{i}" for i in range(len(keys))]
    group = [*names, "_cx", "_cy"]
    state = durable(state.dropDuplicates())

    def united(frame: pd.DataFrame) -> pd.DataFrame:
        pieces = _frame([arranged([_split(s["xs"], s["ys"], s["sizes"]) for s in frame["shape"]], either)])
        return frame.iloc[:1].assign(shape=[pieces.iloc[0].to_dict()])

    def once(state: DataFrame) -> DataFrame:
        """Every group in parts of TOGETHER shapes, until each is one."""
        while True:
            counts = state.groupBy(*group).agg(F.count("*").alias("_n")).toDF(*[f"{c}_" for c in group], "_n")
            most = counts.agg(F.max("_n")).first()[0] or 0
            if most <= 1:
                return state
            parts = F.ceil(F.col("_n") / TOGETHER)
            same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in group]
            met = state.join(counts, same).select(*group, "shape", F.pmod(F.xxhash64("shape"), parts).alias("_part"))
            state = durable(met.groupBy(*group, "_part").applyInPandas(united, met.schema).drop("_part"))

    state = once(state)
    for _ in range(CELL_BITS // ROUND_BITS):
        moved = state.withColumns({c: F.shiftright(c, ROUND_BITS) for c in ("_cx", "_cy")})
        if moved.groupBy(*group).count().where("count > 1").isEmpty():
            state = moved
        else:
            state = once(durable(moved))
    return state.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], rings_of(F.col("shape")).alias("rings"))


__all__ = ["PIECES", "dissolved", "intersections", "once_per_shape", "with_proper_rings"]
