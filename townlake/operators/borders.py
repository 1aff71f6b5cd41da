"""Fewer points for shapes that share borders, without gaps or overlaps between neighbours.

Borders are cut into arcs where more than two ways meet; an arc that two shapes share is one row, thinned
once. Arcs that would cross or run along another are thinned less, and less again, until none does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from townlake.functions.shapes import thinned
from townlake.operators.checkpoints import durable

#: How much less an arc is thinned each time that it is in another's way, and after how many times not at all.
LESS, MOST_TIMES = 4.0, 6
ARC = StructType([StructField("xs", ArrayType(DoubleType())), StructField("ys", ArrayType(DoubleType()))])


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _ends(shapes: DataFrame) -> DataFrame:
    """(x, y): places where arcs end, because not just two ways lead from them."""
    steps = shapes.select(F.explode("rings").alias("ring")).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.size("ring") - 2), lambda i: F.struct(F.get("ring", i).alias("a"), F.get("ring", i + 1).alias("b")))).alias("e")
    )
    ways = steps.select(F.col("e.a").alias("at"), F.col("e.b").alias("to")).unionByName(steps.select(F.col("e.b").alias("at"), F.col("e.a").alias("to"))).distinct()
    return ways.groupBy("at").agg(F.count("*").alias("n")).where("n != 2").select("at.x", "at.y")


def _cut(xs: list, ys: list, end: list) -> list[tuple[list, list, bool]]:
    """The arcs of a closed ring in order, each from its lesser end on, and whether that is back to front."""
    points = list(zip(xs, ys, strict=True))[:-1]
    # A ring where no arc ends is one arc, from its least place on.
    at = [i for i, e in enumerate(end[:-1]) if e] or [points.index(min(points))]
    arcs = []
    for a, b in zip(at, [*at[1:], at[0] + len(points)], strict=True):
        line = [points[i % len(points)] for i in range(a, b + 1)]
        back = line[::-1] < line
        line = line[::-1] if back else line
        arcs.append(([p[0] for p in line], [p[1] for p in line], back))
    return arcs


def _arcs(shapes: DataFrame, ends: DataFrame, id_: str) -> DataFrame:
    """(id, ring, place, back, xs, ys): the arcs of every ring in order."""
    rings = shapes.select(id_, F.posexplode("rings").alias("ring", "points"))
    each = rings.select(id_, "ring", F.posexplode("points").alias("k", "p")).select(id_, "ring", "k", "p.x", "p.y")
    marked = each.join(ends.withColumn("end", F.lit(True)), ["x", "y"], "left")
    rows = marked.groupBy(id_, "ring").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y", F.coalesce("end", F.lit(False)).alias("end")))).alias("v"))
    kind = dict(shapes.dtypes)[id_]

    def cut(frames):
        for frame in frames:
            out = [
                (key, ring, place, back, xs, ys)
                for key, ring, v in zip(frame[id_], frame["ring"], frame["v"], strict=True)
                for place, (xs, ys, back) in enumerate(_cut(*zip(*((p["x"], p["y"], p["end"]) for p in v), strict=True)))
            ]
            yield pd.DataFrame(out, columns=[id_, "ring", "place", "back", "xs", "ys"])

    return rows.mapInPandas(cut, f"`{id_}` {kind}, ring int, place int, back boolean, xs array<double>, ys array<double>")


@F.pandas_udf(ARC)
def _thin(xs: pd.Series, ys: pd.Series, tolerance: pd.Series) -> pd.DataFrame:
    out = []
    for x, y, t in zip(xs, ys, tolerance, strict=True):
        keep = thinned(np.stack([x, y], 1), t) if t > 0 else np.ones(len(x), bool)
        if keep.sum() < 4 and x[0] == x[-1] and y[0] == y[-1]:  # a ring of its own does not fall flat
            keep[:] = True
        out.append((np.asarray(x)[keep], np.asarray(y)[keep]))
    return pd.DataFrame(out, columns=["xs", "ys"])


def _in_the_way(thin: DataFrame, cell: float) -> DataFrame:
    """(arc): arcs with a step that crosses, touches or runs along another step, but for common ends."""
    xs, ys = F.col("thin.xs"), F.col("thin.ys")
    step = lambda i: F.struct(i.alias("i"), F.get(xs, i).alias("ax"), F.get(ys, i).alias("ay"), F.get(xs, i + 1).alias("bx"), F.get(ys, i + 1).alias("by"))
    steps = thin.select("arc", F.explode(F.transform(F.sequence(F.lit(0), F.size(xs) - 2), step)).alias("s")).select("arc", "s.*")
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    placed = durable(steps.withColumn("cx", span("ax", "bx")).withColumn("cy", span("ay", "by")))
    other = placed.select("cx", "cy", *[F.col(c).alias(f"{c}2") for c in ("arc", "i", "ax", "ay", "bx", "by")])
    a, b, c, d = (F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("ax", "ay"), ("bx", "by"), ("ax2", "ay2"), ("bx2", "by2")))
    turn = lambda p, q, r: F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))
    beside = lambda p, q, r: (turn(p, q, r) == 0) & ((r["x"] - p["x"]) * (r["x"] - q["x"]) + (r["y"] - p["y"]) * (r["y"] - q["y"]) < 0)
    across = (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)
    same = ((a == c) & (b == d)) | ((a == d) & (b == c))
    met = placed.join(other, ["cx", "cy"]).where("arc < arc2 or (arc = arc2 and i < i2)")
    bad = met.where(across | same | beside(a, b, c) | beside(a, b, d) | beside(c, d, a) | beside(c, d, b))
    return bad.select(F.explode(F.array("arc", "arc2")).alias("arc")).distinct()


def simplified_together(shapes: DataFrame, id_: str, tolerance: float, cell: float = 0.01) -> DataFrame:
    """(id, rings) with fewer points: none that goes is farther than ``tolerance`` degrees from the line left.

    Common borders stay common, so neighbours have neither gaps nor overlaps, if they shared all points
    of them before; rings keep their order and their turn. Rings of arcs that would cross or fall flat
    keep more points. Steps are compared by cells of ``cell`` degrees. Ids must be unique; shapes
    without rings, and null ones, have no row.
    """
    some = durable(shapes.select(id_, "rings").where(F.size("rings") > 0))
    arcs = durable(_arcs(some, _ends(some), id_).withColumn("arc", F.xxhash64("xs", "ys")))
    lines = durable(arcs.groupBy("arc").agg(F.first("xs").alias("xs"), F.first("ys").alias("ys")).withColumn("times", F.lit(0)))
    while True:
        allowed = F.when(F.col("times") >= MOST_TIMES, 0.0).otherwise(F.lit(tolerance) / F.pow(F.lit(LESS), F.col("times")))
        thin = durable(lines.withColumn("tolerance", allowed.cast("double")).withColumn("thin", _thin("xs", "ys", "tolerance")))
        bad = durable(_in_the_way(thin, cell).join(thin.where(F.col("times") < MOST_TIMES).where(F.size("thin.xs") < F.size("xs")), "arc", "left_semi"))
        if bad.isEmpty():
            break
        less = bad.withColumn("less", F.lit(1))
        lines = durable(lines.join(less, "arc", "left").withColumn("times", F.col("times") + F.coalesce("less", F.lit(0))).drop("less"))
    points = F.zip_with(F.col("thin.xs"), F.col("thin.ys"), _point)
    own = arcs.select(id_, "ring", "place", "back", "arc").join(thin.select("arc", points.alias("line")), "arc")
    # The last place of an arc is the first of the next.
    turned = own.withColumn("line", F.when(F.col("back"), F.reverse("line")).otherwise(F.col("line")))
    ringed = turned.groupBy(id_, "ring").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("parts"))
    open_ = F.flatten(F.transform("parts", lambda p: F.slice(p["line"], F.lit(1), F.size(p["line"]) - 1)))
    closed = ringed.withColumn("points", open_).withColumn("points", F.concat("points", F.slice("points", 1, 1)))
    return closed.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("ring", "points"))).alias("rings")).withColumn("rings", F.transform("rings", lambda r: r["points"]))
