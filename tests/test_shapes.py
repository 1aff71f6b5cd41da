"""Polygons against the geometry library in Spark's JVM, projections, tiles and map results."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from townlake.functions.shapes import (
    area_m2,
    centroid,
    conic,
    from_conic,
    geojson_of_rings,
    metres_to_edges,
    overlap_area,
    rings_of_geojson,
    thinned,
    utm,
)
from townlake.operators.overlay import best_overlap, overlay, same_shape, simplified
from townlake.plans.sandbox import query_features
from townlake.sources.tiles import clipped, encode_tile, geometry_commands, vector_tiles


def star(rng, x, y, size, points=9):
    turns = sorted(rng.random() * 2 * math.pi for _ in range(points))
    ring = [[x + math.cos(t) * size * (0.3 + rng.random()), y + math.sin(t) * size * (0.3 + rng.random())] for t in turns]
    return [*ring, ring[0]]


def polygon(*rings):
    return json.dumps({"type": "Polygon", "coordinates": list(rings)})


def square(x, y, side):
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]


@pytest.fixture(scope="module")
def jts(spark):
    library = spark._jvm.org.locationtech.jts

    def read(geometry):
        rings = json.loads(geometry)["coordinates"]
        text = ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in ring) + ")" for ring in rings)
        return library.io.WKTReader().read(f"POLYGON ({text})")

    return read


def test_shared_area_equals_the_library(spark, jts):
    rng = random.Random(3)
    pairs = []
    while len(pairs) < 30:
        a = polygon(star(rng, 0.5, 0.5, 0.5), square(0.49, 0.49, 0.01)[::-1])
        b = polygon(star(rng, 0.5 + rng.random() / 2, 0.6, 0.4))
        if jts(a).isValid() and jts(b).isValid():
            pairs.append((a, b))
    pairs += [(polygon(square(0, 0, 1)), polygon(square(1, 0, 1))), (polygon(square(0, 0, 1)), polygon(square(0.25, 0.25, 0.5))), (polygon(square(0, 0, 1)), polygon(square(0, 0, 1)))]
    rows = spark.createDataFrame(pairs, "a string, b string").withColumns({"ra": rings_of_geojson(F.col("a")), "rb": rings_of_geojson(F.col("b"))})
    rows = rows.withColumn("s", overlap_area(F.col("ra"), F.col("rb")))
    for r in rows.collect():
        assert r.s == pytest.approx(jts(r.a).intersection(jts(r.b)).getArea(), abs=1e-12)


def test_overlay_and_best_overlap(spark):
    left = spark.createDataFrame([(1, polygon(square(0, 0, 0.1))), (2, polygon(square(1, 1, 0.1))), (3, None)], "a int, g string").select("a", rings_of_geojson(F.col("g")).alias("rings"))
    right = spark.createDataFrame([(7, polygon(square(0.02, 0, 0.1))), (8, polygon(square(-0.07, 0, 0.1))), (9, polygon(square(0.1, 0, 0.1)))], "b int, g string").select("b", rings_of_geojson(F.col("g")).alias("rings"))
    over = overlay(left, right, "a", "b", 0.03)
    assert {(r.a, r.b): round(r.share_of_left, 6) for r in over.collect()} == {(1, 7): 0.8, (1, 8): 0.3}
    assert [(r.a, r.b) for r in best_overlap(left, right, "a", "b").collect()] == [(1, 7)]
    assert [r.b for r in over.where(same_shape(0.5)).collect()] == [7]
    assert overlay(left.limit(0), right, "a", "b").count() == 0


def test_measures_of_a_polygon_with_a_hole(spark, jts):
    shape = polygon(square(23, 42, 0.2)[::-1], square(23.05, 42.05, 0.1))
    row = spark.createDataFrame([(shape,)], "g string").select(rings_of_geojson(F.col("g")).alias("r")).select(
        area_m2(F.col("r")).alias("m2"), centroid(F.col("r")).alias("c"), geojson_of_rings(F.col("r")).alias("g"),
        metres_to_edges(F.col("r"), F.lit(23.1), F.lit(42.1)).alias("inner"), metres_to_edges(F.col("r"), F.lit(23.1), F.lit(41.9)).alias("outer"),
    ).first()
    centre = jts(shape).getCentroid()
    assert (row.c.x, row.c.y) == (pytest.approx(centre.getX()), pytest.approx(centre.getY()))
    assert row.m2 == pytest.approx(0.03 * 111_082 * 82_700, rel=0.01)
    written = json.loads(row.g)["coordinates"]
    assert len(written) == 1 and [len(ring) for ring in written[0]] == [5, 5]
    assert row.outer == pytest.approx(11_108, abs=5) and row.inner == pytest.approx(4_130, abs=15)


def test_projections(spark):
    places = spark.createDataFrame([(23.32, 42.69), (25.5, 42.6678756833333), (27.0, 0.0)], "lon double, lat double")
    east, north = utm(F.col("lon"), F.col("lat"), 35)
    x, y = conic(F.col("lon"), F.col("lat"))
    rows = places.select("lon", "lat", east.alias("e"), north.alias("n"), x.alias("x"), y.alias("y"))
    back = from_conic(F.col("x"), F.col("y"))
    rows = rows.select("*", back[0].alias("lon2"), back[1].alias("lat2")).collect()
    assert all(abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9 for r in rows if r.lat > 1)
    assert (rows[1].x, rows[1].y) == (pytest.approx(500_000, abs=0.01), pytest.approx(4_725_824.3591, abs=0.01))
    assert (rows[2].e, rows[2].n) == (pytest.approx(500_000), pytest.approx(0, abs=1e-6))
    assert 190_000 < rows[0].e < 205_000 and 4_730_000 < rows[0].n < 4_740_000


def test_simplified_stays_near(spark):
    ring = [[math.cos(k / 100 * math.pi), math.sin(k / 100 * math.pi)] for k in range(200)]
    shapes = spark.createDataFrame([(polygon([*ring, ring[0]], square(0, 0, 0.01)[::-1]),)], "g string")
    rings = simplified(shapes.select(rings_of_geojson(F.col("g")).alias("rings")), 0.05).first().rings
    assert rings[0][0] == rings[0][-1] and 6 < len(rings[0]) < 30 and len(rings[1]) == 5
    line = np.array([[0.0, 0.0], [1, 0.01], [2, 0], [3, 5], [4, 0]])
    assert thinned(line, 0.1).tolist() == [True, False, True, True, True]


def _fields(raw):
    at, out = 0, []

    def number():
        nonlocal at
        n = shift = 0
        while True:
            n |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return n

    while at < len(raw):
        key = number()
        if key & 7 == 2:
            size = number()
            out.append((key >> 3, raw[at : at + size]))
            at += size
        elif key & 7 == 1:
            out.append((key >> 3, raw[at : at + 8]))
            at += 8
        else:
            out.append((key >> 3, number()))
    return out


def test_tiles_hold_what_was_put_in(spark):
    points = spark.createDataFrame([(2, 0.001, 0.001, "b"), (1, 0.001, 0.001, None), (3, -0.001, 0.001, "c")], "id long, lon double, lat double, name string")
    tiles = {(r.x, r.y): r for r in vector_tiles(points, "id", ["name"], 1, "places").collect()}
    assert sorted(tiles) == [(0, 0), (1, 0)] and tiles[1, 0].features == 2
    layer = _fields(_fields(bytes(tiles[1, 0].tile))[0][1])
    assert [v for k, v in layer if k == 1] == [b"places"] and [v for k, v in layer if k == 5] == [4096]
    ids = [dict(_fields(v))[1] for k, v in layer if k == 2]
    assert ids == [1, 2]
    shape = spark.createDataFrame([(5, polygon(square(-1, -1, 2)))], "id long, g string").select("id", rings_of_geojson(F.col("g")).alias("rings"))
    assert vector_tiles(shape, "id", [], 1, "areas").agg(F.sum("features")).first()[0] == 4


def test_tile_parts():
    assert clipped(np.array([[0.0, 0], [10, 0], [10, 10], [0, 10]]), 2, 5).tolist() != []
    assert np.ptp(clipped(np.array([[0.0, 0], [10, 0], [10, 10], [0, 10]]), 2, 5), axis=0).tolist() == [3, 3]
    assert len(clipped(np.array([[0.0, 0], [1, 0], [1, 1]]), 2, 5)) == 0
    assert geometry_commands(3, [np.array([[3, 6], [8, 12], [20, 34]])]) == [9, 6, 12, 18, 10, 12, 24, 44, 15]
    raw = encode_tile("x", [(1, {"a": 1, "b": "q", "c": 0.5, "d": True, "e": None}, 1, [9, 2, 2])])
    assert [k for k, _ in _fields(_fields(raw)[0][1])] == [1, 2, 3, 3, 3, 3, 4, 4, 4, 4, 5, 15]


def test_map_results(spark):
    spark.sql("""SELECT 1 AS id, '{"type":"Point","coordinates":[23.0,42.0]}' AS geom UNION ALL SELECT 2, NULL""").createOrReplaceTempView("places_to_map")
    got = query_features(spark, "SELECT * FROM places_to_map")
    assert got["bbox"] == [23.0, 42.0, 23.0, 42.0] and got["without_geometry"] == 1 and got["features"][0]["properties"] == {"id": 1}
    for bad in ("SELECT id FROM places_to_map", "SELECT 'x' AS geom", "DROP VIEW places_to_map", ""):
        assert "error" in query_features(spark, bad), bad
    many = query_features(spark, "SELECT geom FROM places_to_map, range(6000) WHERE geom IS NOT NULL")
    assert many["truncated"] and len(many["features"]) == 5000 and not got["truncated"]
    spark.catalog.dropTempView("places_to_map")
