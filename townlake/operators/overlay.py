"""Polygons over polygons: what they share, the best match, and pieces of map tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townlake.functions.shapes import kept_points, overlap_area, signed_area
from townlake.operators.spatial import box_overlaps
from townlake.operators.tables import first_per_key


def bounded(rows: DataFrame, key: str) -> DataFrame:
    """(key, rings, area, x0, y0, x1, y1): polygons with their bounds."""
    xs, ys = F.transform(F.flatten("rings"), lambda p: p["x"]), F.transform(F.flatten("rings"), lambda p: p["y"])
    area = F.aggregate("rings", F.lit(0.0), lambda s, ring: s + signed_area(ring))
    bounds = {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}
    return rows.select(F.col(key).alias("key"), "rings", area.alias("area"), *[c.alias(name) for name, c in bounds.items()])


def overlay(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell_size: float = 0.05) -> DataFrame:
    """(left_id, right_id, share_of_left, share_of_right) of polygons that share ground.

    Candidates are those whose bounds overlap, found by grid cells of ``cell_size`` degrees; the
    shared area is exact, with holes and parts. The names of the ids must differ.
    """
    pairs = box_overlaps(bounded(left, left_id), bounded(right, right_id), cell_size)
    shared = pairs.withColumn("_shared", overlap_area(F.col("rings_l"), F.col("rings_r"))).where("_shared > 0")
    return shared.select(
        F.col("key_l").alias(left_id),
        F.col("key_r").alias(right_id),
        (F.col("_shared") / F.col("area_l")).alias("share_of_left"),
        (F.col("_shared") / F.col("area_r")).alias("share_of_right"),
    )


def best_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, least: float = 0.5, cell_size: float = 0.05) -> DataFrame:
    """For each left polygon the right one that covers the most of it, over ``least``; ties to the lower id."""
    over = overlay(left, right, left_id, right_id, cell_size).where(F.col("share_of_left") > least)
    return first_per_key(over, [left_id], [F.col("share_of_left").desc(), F.col(right_id)])


def same_shape(least: float) -> Column:
    """Whether a row of ``overlay`` pairs two shapes that are ``least`` alike, of the larger one's area."""
    return F.least("share_of_left", "share_of_right") >= least


def simplified(rows: DataFrame, tolerance: float) -> DataFrame:
    """``rows`` with ``rings`` without points nearer than ``tolerance`` degrees to the line left.

    Rings that would fall flat keep all their points, so no part or hole is lost.
    """
    sizes = F.transform("rings", F.size)

    def of_ring(ring: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda s, n: s + n)
        return F.filter(ring, lambda _, k: F.get("_keep", start + k))

    kept = rows.withColumn("_keep", kept_points(F.col("rings"), tolerance))
    return kept.withColumn("rings", F.transform("rings", of_ring)).drop("_keep")
