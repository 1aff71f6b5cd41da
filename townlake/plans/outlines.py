"""Hexagons over the made city: measures, cuts, containment, lines and extents."""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townlake.functions.outlines import cut_to_box, geometry_kind, is_simple, planar_area, point_on_surface, points_of, wkt
from townlake.operators.overlay import overlay
from townlake.operators.spatial import areas_of_points, box_rings, lines_of_points, nearest_k
from townlake.plans.tables import BOXES_SQL, BUILDINGS_SQL, FACILITIES_SQL, boxes, buildings, facilities, metres_sql

#: Half the width and half the height of a hexagon, in degrees.
REACH_X, REACH_Y = 0.045, 0.04


def _corners() -> list[tuple[float, float]]:
    return [(REACH_X * cos(pi / 3 * k), REACH_Y * sin(pi / 3 * k)) for k in range(6)]


def hexagons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hexagon in the middle of each nation's box, turning left."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(*[corner(*c) for c in [*_corners(), _corners()[0]]])
    return boxes(spark, sf_dir).select("area", "x0", "y0", "x1", "y1", F.array(ring).alias("rings"))


def hexagon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, points, area, inner point and validity of each hexagon, and the area of its western half."""
    inner = point_on_surface(F.col("rings"))
    middle = (F.col("x0") + F.col("x1")) / 2
    west = F.array(cut_to_box(F.get("rings", F.lit(0)), F.col("x0"), F.col("y0"), middle, F.col("y1")))
    return hexagons(spark, sf_dir).select(
        "area", geometry_kind(F.col("rings")).alias("kind"), points_of(F.col("rings")).cast("long").alias("points"),
        F.round(planar_area(F.col("rings")) * 1e6, 3).alias("size"), F.round(planar_area(west) * 1e6, 3).alias("west"),
        F.round(inner["x"], 6).alias("x"), is_simple(F.get("rings", F.lit(0))).alias("valid"), F.substring(wkt(F.col("rings"), 3), 1, 9).alias("text"),
    )


def hexagon_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings by the hexagon that they are in, whose areas leave gaps between them."""
    found = areas_of_points(buildings(spark, sf_dir), hexagons(spark, sf_dir), "c_custkey", "area", 3000.0)
    return found.groupBy("area").agg(F.count("*").alias("buildings"))


def hexagon_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexagons and boxes that share ground: covered or not, and areas of union and of what only one has, in parts of the box's."""
    box = boxes(spark, sf_dir).select(F.col("area").alias("box"), F.array(F.get(box_rings(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), F.lit(0))).alias("rings"))
    shared = overlay(hexagons(spark, sf_dir).select("area", "rings"), box, "area", "box")
    own = F.col("share_of_right") / F.col("share_of_left")  # the hexagon's area in boxes
    return shared.where("share_of_left > 0.5").select(
        "area", "box", (F.col("share_of_left") > 1 - 1e-9).alias("covered"), F.round(own + 1 - F.col("share_of_right"), 4).alias("union"),
        F.round(own + 1 - 2 * F.col("share_of_right"), 4).alias("only_one"),
    )


def nation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extent of each nation's buildings and the length of the line through them in the order of their keys."""
    lines = lines_of_points(buildings(spark, sf_dir), "c_nationkey", "c_custkey")
    extent = [F.round(c, 6).alias(c) for c in ("west", "east", "south", "north")]
    return lines.select("c_nationkey", F.round("metres").cast("long").alias("metres"), "points", *extent)


def three_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest facilities of each building that are of its own region's class and not in debt."""
    places = facilities(spark, sf_dir).where("s_acctbal > 0").select("s_suppkey", (F.col("s_nationkey") % 5).alias("class"), "lon", "lat")
    homes = buildings(spark, sf_dir).select("c_custkey", F.col("n_regionkey").cast(dict(places.dtypes)["class"]).alias("class"), "lon", "lat")
    found = nearest_k(homes, places, "c_custkey", "s_suppkey", 3, 2000.0, on=["class"])
    return found.select("c_custkey", "s_suppkey", F.col("place").cast("long").alias("place"), F.round("distance_m").cast("long").alias("distance_m"))


QUERIES = {f.__name__: f for f in (hexagon_measures, hexagon_buildings, hexagon_relations, nation_lines, three_nearest)}

_HEX = f"{BOXES_SQL}, h AS (SELECT *, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM boxes)"
_SIZE = 1.5 * 3**0.5 * REACH_X * REACH_Y
_BOX = 0.0918 * 0.0816

ORACLES = {
    "hexagon_measures": f"""WITH {_HEX} SELECT area, 'Polygon' AS kind, CAST(7 AS BIGINT) AS points, round({_SIZE!r}e0 * 1e6, 3) AS size, round({_SIZE / 2!r}e0 * 1e6, 3) AS west,
       round(mx, 6) AS x, true AS valid, 'POLYGON((' AS text FROM h""",
    "hexagon_buildings": f"""WITH {BUILDINGS_SQL}, {_HEX}, p AS (SELECT c_custkey, min(area) AS area FROM buildings JOIN h
  ON abs(lat - my) / {REACH_Y!r}e0 <= sqrt(3) / 2 AND sqrt(3) * abs(lon - mx) / {REACH_X!r}e0 + abs(lat - my) / {REACH_Y!r}e0 <= sqrt(3) GROUP BY 1)
SELECT area, count(*) AS buildings FROM p GROUP BY 1""",
    "hexagon_relations": f"""WITH {_HEX} SELECT area, area AS box, true AS covered, CAST(1 AS DOUBLE) AS "union", round(1 - {_SIZE / _BOX!r}e0, 4) AS only_one FROM h""",
    "nation_lines": f"""WITH {BUILDINGS_SQL}, o AS (SELECT c_nationkey, lon, lat, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM buildings WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
d AS (SELECT c_nationkey, lon, lat, {metres_sql('a', 'b')} AS m FROM (SELECT o.c_nationkey, o.lon, o.lat, {{'lon': lon0, 'lat': lat0}} AS a, {{'lon': lon, 'lat': lat}} AS b FROM o))
SELECT c_nationkey, CAST(round(sum(m)) AS BIGINT) AS metres, count(*) AS points, round(min(lon), 6) AS west, round(max(lon), 6) AS east, round(min(lat), 6) AS south, round(max(lat), 6) AS north
FROM d GROUP BY 1""",
    "three_nearest": f"""WITH {BUILDINGS_SQL}, {FACILITIES_SQL}, p AS (SELECT c_custkey, s_suppkey, {metres_sql('b', 'f')} AS d FROM buildings b JOIN facilities f ON s_nationkey % 5 = n_regionkey AND s_acctbal > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS place FROM p)
SELECT c_custkey, s_suppkey, place, CAST(round(d) AS BIGINT) AS distance_m FROM r WHERE place <= 3""",
}
