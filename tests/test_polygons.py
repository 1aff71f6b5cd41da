"""Shapes made of shapes, repair and validity against the geometry library in Spark's JVM; nearest outlines and far places by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from townlake.functions import arrangement
from townlake.functions.geo import distance_m
from townlake.functions.shapes import metres_to_edges
from townlake.operators import polygons
from townlake.operators.spatial import in_rings, lines_of_points, nearest, nearest_k, nearest_outline
from tests.test_shapes import square, star

RINGS = "array<array<struct<x: double, y: double>>>"


@pytest.fixture(scope="module")
def jts(spark):
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    ring = lambda r: "(" + ", ".join(f"{float(x)!r} {float(y)!r}" for x, y in r) + ")"

    def read(rings):
        """Outer rings turn left and are followed by their holes."""
        parts = []
        for r in rings:
            area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(r, list(r)[1:], strict=False))
            if area > 0 or not parts:
                parts.append([])
            parts[-1].append(ring(r))
        return reader.read("MULTIPOLYGON (" + ", ".join("(" + ", ".join(p) + ")" for p in parts) + ")")

    return read


def hexagon(x, y, r):
    ring = [[x + r * math.cos(k * math.pi / 3), y + r * math.sin(k * math.pi / 3)] for k in range(6)]
    return [*ring, ring[0]]


def arrays(rings):
    return [np.array(r, float) for r in rings]


def nested(rings):
    return [[(float(x), float(y)) for x, y in r] for r in rings]


def test_shapes_of_two_equal_the_library(jts):
    rng = random.Random(1)
    done = holes = parts = 0
    while done < 500:
        cx, cy = 0.5, 0.5
        a = [star(rng, cx, cy, 0.5), square(cx - 0.02, cy - 0.02, 0.04)[::-1]]
        b = [star(rng, cx + rng.random() / 2, 0.6, 0.4)]
        ja, jb = jts(a), jts(b)
        if not (ja.isValid() and jb.isValid()):
            continue
        done += 1
        for rule, want in ((arrangement.both, ja.intersection(jb)), (arrangement.either, ja.union(jb)), (arrangement.first_only, ja.difference(jb)), (arrangement.one_only, ja.symDifference(jb))):
            got = arrangement.arranged([arrays(a), arrays(b)], rule)
            if want.isEmpty():
                assert got == []
                continue
            found = jts(got)
            assert found.isValid() and arrangement.is_valid(got)
            assert found.symDifference(want).getArea() < 1e-7
            assert found.getNumGeometries() == sum(1 for g in range(want.getNumGeometries()) if want.getGeometryN(g).getArea() > 1e-9)
            holes += len(got) > found.getNumGeometries()
            parts += found.getNumGeometries() > 1
    assert holes > 100 and parts > 100


IMPROPER = {
    "bow-tie": ([[[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]]], 2.0),
    "ring that touches itself": ([[[0, 0], [4, 0], [4, 4], [2, 0], [0, 4], [0, 0]]], 8.0),
    "spike": ([[[0, 0], [2, 0], [2, 1], [5, 1], [2, 1], [2, 2], [0, 2], [0, 0]]], 4.0),
    "hole outside": ([square(0, 0, 2), square(5, 5, 1)[::-1]], 5.0),
    "hole over the border": ([square(0, 0, 2), square(1, 1, 2)[::-1]], 6.0),
    "two equal holes": ([square(0, 0, 4), square(1, 1, 1)[::-1], square(1, 1, 1)[::-1]], 16.0),
    "parts that overlap": ([square(0, 0, 2), square(1, 1, 2)], 6.0),
    "parts with a common border": ([square(0, 0, 2), square(2, 0, 2)], 8.0),
    "flat": ([[[0, 0], [1, 1], [2, 2], [0, 0]]], 0.0),
    "two points": ([[[0, 0], [1, 1], [0, 0]]], 0.0),
    "hole that cuts through": ([square(0, 0, 4), [[0, 2], [2, 3], [4, 2], [2, 1], [0, 2]]], 12.0),
}
PROPER = {
    "none": ([], 0.0),
    "hole": ([square(0, 0, 4), square(1, 1, 1)[::-1]], 15.0),
    "hole that touches the border": ([square(0, 0, 4), [[0, 2], [1, 3], [1, 1], [0, 2]]], 15.0),
    "parts that touch": ([square(0, 0, 2), square(2, 2, 2)], 8.0),
    "a part in a hole": ([square(0, 0, 6), square(1, 1, 4)[::-1], square(2, 2, 1)], 21.0),
    "bent": ([[[0, 0], [4, 0], [4, 4], [2, 1], [0, 4], [0, 0]]], 10.0),
}


@pytest.mark.parametrize("name", [*IMPROPER, *PROPER])
def test_validity_and_repair(jts, name):
    rings, area = (IMPROPER | PROPER)[name]
    assert arrangement.is_valid(arrays(rings)) == (name in PROPER)
    if len(rings) and min(map(len, rings)) > 3:
        turned = rings if name != "hole that cuts through" else [rings[0], rings[1][::-1]]
        assert jts(turned).isValid() == (name in PROPER)
    mended = arrangement.arranged([arrays(rings)], arrangement.either)
    assert arrangement.is_valid(mended)
    assert sum(arrangement._area2(r[:-1]) for r in mended) / 2 == pytest.approx(area, abs=1e-8)


def test_stars_are_judged_as_by_the_library(jts):
    rng = random.Random(7)
    judged = [0, 0]
    for _ in range(300):
        t = [rng.random() * 2 * math.pi for _ in range(8)]
        if rng.random() < 0.6:
            t.sort()
        ring = [[math.cos(a) * (0.3 + rng.random()), math.sin(a) * (0.3 + rng.random())] for a in t]
        area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
        ring = ring if area > 0 else ring[::-1]
        want = jts([[*ring, ring[0]]]).isValid()
        assert arrangement.is_valid(arrays([[*ring, ring[0]]])) == want
        judged[want] += 1
    assert min(judged) > 50


def test_polygon_operators_on_tables(spark):
    rows = [(1, nested([square(0, 0, 0.1)])), (2, nested([[[1, 1], [1.1, 1.1], [1.1, 1], [1, 1.1], [1, 1]]])), (3, None), (4, [])]
    table = spark.createDataFrame(rows, f"a int, rings {RINGS}")
    mended = {r.a: (r.was_valid, len(r.rings)) for r in polygons.with_proper_rings(table).collect()}
    assert mended == {1: (True, 1), 2: (False, 2), 3: (False, 0), 4: (True, 0)}
    other = spark.createDataFrame([(9, nested([square(0.05, 0.05, 0.1)]))], f"b int, rings {RINGS}")
    found = polygons.intersections(table.where("a = 1"), other, "a", "b").collect()
    assert [(r.a, r.b) for r in found] == [(1, 9)]
    assert np.allclose(sorted(set(found[0].rings[0])), [(0.05, 0.05), (0.05, 0.1), (0.1, 0.05), (0.1, 0.1)])
    assert polygons.intersections(table.where("a > 9"), other, "a", "b").count() == 0


def test_union_of_groups_equals_the_library(spark, jts, monkeypatch):
    monkeypatch.setattr(polygons, "TOGETHER", 4)
    rng = random.Random(5)
    groups = {"boxes": [[square(x * 0.09, y * 0.08, 0.1)] for x in range(5) for y in range(5)]}
    groups["hexagons"] = [[hexagon(x * 0.15, y * 0.13, 0.07)] for x in range(4) for y in range(4)]
    groups["same"] = [[square(0.3, 0.3, 0.2)]] * 50
    groups["stars"] = []
    while len(groups["stars"]) < 25:
        shape = [star(rng, rng.random(), rng.random(), 0.2)]
        if jts(shape).isValid():
            groups["stars"].append(shape)
    groups[None] = [[square(7, 7, 1)]]
    rows = [(k, nested(s)) for k, shapes in groups.items() for s in shapes] + [("stars", None), ("none", [])]
    got = {r.kind: [np.array(x) for x in r.rings] for r in polygons.dissolved(spark.createDataFrame(rows, f"kind string, rings {RINGS}").repartition(5), ["kind"]).collect()}
    assert set(got) == set(groups)
    for kind, shapes in groups.items():
        want = jts(shapes[0])
        for s in shapes[1:]:
            want = want.union(jts(s))
        assert arrangement.is_valid(got[kind])
        assert jts(got[kind]).symDifference(want).getArea() < 1e-7


def test_nearest_outline_equals_brute_force(spark):
    rng = random.Random(8)
    areas = [(k, nested([star(rng, 23 + rng.random(), 42 + rng.random(), 0.06, 12)])) for k in range(25)] + [(99, nested([square(40, 60, 0.5)]))]
    points = [(i, 22.9 + 1.2 * rng.random(), 41.9 + 1.2 * rng.random()) for i in range(200)] + [(500, 40.2, 60.1), (501, 39.0, 61.0)]
    a, p = spark.createDataFrame(areas, f"area int, rings {RINGS}"), spark.createDataFrame(points, "p int, lon double, lat double")
    inside = in_rings(F.col("rings"), F.col("lon"), F.col("lat"))
    every = p.crossJoin(a).withColumn("d", F.when(inside, 0.0).otherwise(metres_to_edges(F.col("rings"), F.col("lon"), F.col("lat"))))
    want = {r.p: (r.b.area, r.b.d) for r in every.groupBy("p").agg(F.min(F.struct("d", "area")).alias("b")).collect()}
    got = {r.p: (r.area, r.distance_m) for r in nearest_outline(p, a, "p", "area", 2000.0).collect()}
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-6, abs=1e-3) for k in want)
    assert sum(d == 0 for _, d in got.values()) > 5


@pytest.mark.parametrize("places", [10, 70])
def test_far_rows_are_found_however_many_places_there_are(spark, places):
    """The far side of the globe and across the poles: no row is lost, and the nearest is that of the sphere."""
    rng = random.Random(places)
    right = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(places)] + [(1000, 10.0, 89.0)]
    left = [(1, 179.9, 0.5), (2, -170.0, 89.5), (3, 0.0, 0.0), (4, 180.0, -89.9), (5, 120.0, -40.0)]

    def sphere(a, b):
        (x, y), (u, v) = (tuple(map(math.radians, p)) for p in (a, b))
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
        return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))

    l, r = spark.createDataFrame(left, "l int, lon double, lat double"), spark.createDataFrame(right, "r int, lon double, lat double")
    want = {i: min((sphere((x, y), (u, v)), k) for k, u, v in right) for i, x, y in left}
    for got in (nearest(l, r, "l", "r"), nearest_k(l, r, "l", "r", 1)):
        rows = {x.l: x for x in got.collect()}
        assert {k: x.r for k, x in rows.items()} == {k: b[1] for k, b in want.items()}
        assert all(rows[k].distance_m == pytest.approx(want[k][0], rel=0.006, abs=1) for k in want)
    assert want[2][1] == 1000  # over the pole
    assert nearest_k(l, r, "l", "r", 3).count() == 3 * len(left)


def test_distances_have_no_gap_between_ellipsoid_and_sphere(spark):
    rows = spark.createDataFrame([(lat, lat + d) for lat in (0.0, 42.5, 84.0) for d in (0.895, 0.905)], "a double, b double")
    for r in rows.withColumn("m", distance_m(F.lit(20.0), F.col("a"), F.lit(20.0), F.col("b"))).collect():
        assert r.m == pytest.approx((r.b - r.a) * 111_195, rel=0.006)


def test_lines_in_blocks_are_as_long_as_whole_ones(spark):
    rng = random.Random(3)
    points = [(rng.choice("ab"), i * 7, 23 + rng.random(), 42 + rng.random()) for i in range(300)] + [("c", 5, 1.0, 2.0), ("a", 4, None, 2.0), (None, 1, 1.0, 1.0), (None, 2, 1.0, 1.1)]
    table = spark.createDataFrame(points, "line string, n long, lon double, lat double").repartition(4)
    whole, parts = ({r.line: (round(r.metres, 3), r.points, r.west, r.north) for r in lines_of_points(table, "line", "n", block).collect()} for block in (10**6, 50))
    assert whole == parts and whole["c"][:2] == (0, 1) and whole[None][1] == 2 and whole["a"][0] > 1e6
