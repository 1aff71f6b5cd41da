"""Forms of outlines: parts, texts, inner points, validity and cuts, as expressions on ``rings``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from townlake.functions.shapes import edges, signed_area


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def planar_area(rings: Column) -> Column:
    """Area in square degrees; holes turn the other way and count less."""
    return F.aggregate(rings, F.lit(0.0), lambda s, ring: s + signed_area(ring))


def points_of(rings: Column) -> Column:
    """How many points the outlines have, the closing ones included."""
    return F.aggregate(rings, F.lit(0), lambda s, ring: s + F.size(ring))


def geometry_kind(rings: Column) -> Column:
    """Polygon or MultiPolygon by the number of outer rings; null for none."""
    outer = F.size(F.filter(rings, lambda r: signed_area(r) > 0))
    return F.when(F.coalesce(F.size(rings), F.lit(0)) <= 0, None).when(outer > 1, "MultiPolygon").otherwise("Polygon")


def wkt(rings: Column, digits: int = 6) -> Column:
    """Well-known text of one polygon with its holes."""
    number = lambda v: F.format_string(f"%.{digits}f", v)
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"]))), ","), F.lit(")"))
    return F.when(F.size(rings) > 0, F.concat(F.lit("POLYGON("), F.array_join(F.transform(rings, ring), ","), F.lit(")"))).otherwise("POLYGON EMPTY")


def point_on_surface(rings: Column) -> Column:
    """A point inside: the middle of the widest piece of a line across, between the two middle heights of points."""

    def of_line(y: Column) -> Column:
        every = F.flatten(F.transform(rings, edges))
        met = F.filter(every, lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
        xs = F.array_sort(F.transform(met, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))
        pieces = let(xs, lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda i: F.struct((F.get(v, 2 * i + 1) - F.get(v, 2 * i)).alias("w"), ((F.get(v, 2 * i + 1) + F.get(v, 2 * i)) / 2).alias("x"))))
        return F.struct(F.array_max(pieces)["x"].alias("x"), y.alias("y"))

    heights = F.array_sort(F.array_distinct(F.transform(F.flatten(rings), lambda p: p["y"])))
    middle = let(heights, lambda h: (F.get(h, F.floor((F.size(h) - 1) / 2).cast("int")) + F.get(h, F.floor((F.size(h) + 1) / 2).cast("int"))) / 2)
    return F.when(F.size(rings) > 0, let(middle, of_line))


def is_simple(ring: Column) -> Column:
    """Whether no two edges of a closed ring cross, and it is closed and has at least four points."""
    turn = lambda p, q, r: F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    def crosses(e: Column, f: Column) -> Column:
        a, b = turn(e["a"], e["b"], f["a"]) * turn(e["a"], e["b"], f["b"]), turn(f["a"], f["b"], e["a"]) * turn(f["a"], f["b"], e["b"])
        return (a < 0) & (b < 0)

    closed = (F.size(ring) > 3) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1))
    return closed & ~let(edges(ring), lambda every: F.exists(every, lambda e: F.exists(every, lambda f: crosses(e, f))))


def cut_to_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part of a closed ring inside a box, closed again; empty if there is none. One piece if the ring bends inward."""

    def half(points: Column, axis: str, bound: Column, sign: int) -> Column:
        inside = lambda p: (p[axis] - bound) * sign >= 0
        other = "y" if axis == "x" else "x"

        def meet(a: Column, b: Column) -> Column:
            at = a[other] + (bound - a[axis]) / (b[axis] - a[axis]) * (b[other] - a[other])
            values = {axis: bound.cast("double"), other: at}
            return F.struct(values["x"].alias("x"), values["y"].alias("y"))

        def of_edge(e: Column) -> Column:
            a, b = e["a"], e["b"]
            now, then = inside(b), inside(a)
            return F.when(now & then, F.array(b)).when(now, F.array(meet(a, b), b)).when(then, F.array(meet(a, b))).otherwise(F.array().cast("array<struct<x: double, y: double>>"))

        kept = F.flatten(F.transform(edges(points), of_edge))
        return let(kept, lambda k: F.when(F.size(k) > 0, F.concat(k, F.array(F.get(k, F.lit(0))))).otherwise(k))

    def cut(points: Column, axis: str, bound: Column, sign: int) -> Column:
        return let(points, lambda r: F.when(F.size(r) > 1, half(r, axis, bound, sign)).otherwise(r))

    return cut(cut(cut(cut(ring, "x", x0, 1), "x", x1, -1), "y", y0, 1), "y", y1, -1)
