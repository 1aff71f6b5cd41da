"""Polygons as results over the made city: shared ground, mended outlines, dissolved regions, nearest outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townlake.functions.arrangement import valid
from townlake.functions.outlines import planar_area
from townlake.operators.borders import simplified_together
from townlake.operators.polygons import dissolved, intersections, once_per_shape, with_proper_rings
from townlake.operators.spatial import box_rings, nearest_outline
from townlake.plans.tables import BOXES_SQL, BUILDINGS_SQL, SOUTH, WEST, boxes, buildings, table

#: A hole in each area, from its lower left corner: x and y of its own corners, in degrees.
HOLE = (0.03, 0.03, 0.06, 0.05)
#: How far zones lie to the north-east of areas.
EAST, NORTH = 0.035, 0.025
#: Bends up to which borders are made straight, in degrees.
BEND = 0.0025
#: A park in each area, from its lower left corner; parks whose area's key this divides are planned.
PARK, PLANNED = (0.02, 0.02, 0.05, 0.045), 3


def _ring(*corners: tuple[Column, Column]) -> Column:
    points = [F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners]
    return F.array(*points, points[0])


def _moved(x: float, y: float) -> tuple[Column, Column]:
    return F.col("x0") + x, F.col("y0") + y


def _size(rings: Column) -> Column:
    return F.round(planar_area(rings) * 1e6, 3).alias("size")


def holed_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' boxes, each with a hole."""
    a, b, c, d = HOLE
    hole = _ring(_moved(a, b), _moved(a, d), _moved(c, d), _moved(c, b))
    outer = F.get(box_rings(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), F.lit(0))
    return boxes(spark, sf_dir).select("area", F.array(outer, hole).alias("rings"))


def zone_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground that holed areas and zones share, as shapes: size, holes, parts."""
    zones = boxes(spark, sf_dir).select(F.col("area").alias("zone"), box_rings(*_moved(EAST, NORTH), F.col("x1") + EAST, F.col("y1") + NORTH).alias("rings"))
    found = intersections(holed_areas(spark, sf_dir), zones, "area", "zone")
    outer = F.size(F.filter("rings", lambda r: planar_area(F.array(r)) > 0))
    return found.select("area", "zone", _size(F.col("rings")), (F.size("rings") - outer).cast("long").alias("holes"), valid(F.col("rings")).alias("valid"))


def repaired_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of parts, three of four improper: a bow-tie, one with a spike, one with a hole outside; valid before, and size when mended."""
    wide, tall = F.col("p_size") * 0.001, (F.col("p_partkey") % 7 + 1) * 0.002
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit(23.0).alias("x0"), F.lit(42.0).alias("y0"), wide.alias("w"), tall.alias("h"))
    x1, y1 = F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    x0, y0 = F.col("x0"), F.col("y0")
    box = _ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    bow_tie = _ring((x0, y0), (x1, y1), (x1, y0), (x0, y1))
    spike = _ring((x0, y0), (x1, y0), (x1, y1), (x1 + 1, y1), (x1, y1), (x0, y1))
    outside = _ring((x0 + 2, y0), (x0 + 2, y1), (x1 + 2, y1), (x1 + 2, y0))
    kind = F.col("p_partkey") % 4
    rings = F.when(kind == 0, F.array(box)).when(kind == 1, F.array(bow_tie)).when(kind == 2, F.array(spike)).otherwise(F.array(box, outside))

    def judged(shapes: DataFrame) -> DataFrame:
        mended = with_proper_rings(shapes.withColumn("rings", F.col("shape")))
        return mended.select("shape", "was_valid", _size(F.col("rings")), valid(F.col("rings")).alias("valid"))

    return once_per_shape(rows.select("p_partkey", rings.alias("rings")), judged).select("p_partkey", "was_valid", "size", "valid")


def dissolved_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the boxes of each region's nations, which overlap."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"), "n_regionkey")
    areas = boxes(spark, sf_dir).join(F.broadcast(nation), "area").select("n_regionkey", box_rings(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("rings"))
    whole = dissolved(areas, ["n_regionkey"])
    return whole.select("n_regionkey", _size(F.col("rings")), valid(F.col("rings")).alias("valid"))


def nearest_park(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each building its nearest park, 0 metres inside: an existing one, unless a planned one is over 300 metres nearer."""
    a, b, c, d = PARK
    parks = boxes(spark, sf_dir).select(F.col("area").alias("park"), box_rings(*_moved(a, b), *_moved(c, d)).alias("rings"))
    homes, planned = buildings(spark, sf_dir).select("c_custkey", "lon", "lat"), F.col("park") % PLANNED == 0
    now = nearest_outline(homes, parks.where(~planned), "c_custkey", "park", 3000.0)
    later = nearest_outline(homes, parks.where(planned), "c_custkey", "park", 3000.0).select("c_custkey", F.col("park").alias("new_park"), F.col("distance_m").alias("new_m"))
    keep = F.col("distance_m") <= F.col("new_m") + 300
    return now.join(later, "c_custkey").select(
        "c_custkey", F.when(keep, F.col("park")).otherwise(F.col("new_park")).alias("park"), keep.alias("existing"),
        F.round(F.when(keep, F.col("distance_m")).otherwise(F.col("new_m"))).cast("long").alias("metres"),
    )


def simplified_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of areas whose common borders have a bend each, thinned together: points and size of each area."""
    column, row = F.col("area") % 5, F.floor(F.col("area") / 5)
    x, y = (lambda i: F.lit(WEST) + i * 0.09), (lambda j: F.lit(SOUTH) + j * 0.08)
    upright = lambda i, j: (x(i) + (i * 7 + j * 3) % 5 * 0.001, y(j) + 0.04)
    level = lambda i, j: (x(i) + 0.045, y(j) + (i * 3 + j * 7) % 5 * 0.001)
    corner = lambda i, j: (x(i), y(j))
    ring = _ring(
        corner(column, row), level(column, row), corner(column + 1, row), upright(column + 1, row),
        corner(column + 1, row + 1), level(column, row + 1), corner(column, row + 1), upright(column, row),
    )
    areas = boxes(spark, sf_dir).select("area", F.array(ring).alias("rings"))
    thin = simplified_together(areas, "area", BEND)
    return thin.select("area", F.size(F.get("rings", F.lit(0))).cast("long").alias("points"), _size(F.col("rings")))


QUERIES = {f.__name__: f for f in (zone_pieces, repaired_outlines, dissolved_regions, nearest_park, simplified_borders)}


def _overlap(a: str, b: str, low: str, high: str) -> str:
    return f"greatest(0, least({a}.{high}, {b}.{high}) - greatest({a}.{low}, {b}.{low}))"


_SHARED = f"{_overlap('a', 'z', 'x0', 'x1')} * {_overlap('a', 'z', 'y0', 'y1')}"
_HOLE_SHARED = f"{_overlap('h', 'z', 'x0', 'x1')} * {_overlap('h', 'z', 'y0', 'y1')}"
_W = "(1 - 0.0066943799901413165e0 * pow(sin(radians(lat)), 2))"

ORACLES = {
    "zone_pieces": f"""WITH {BOXES_SQL}, holes AS (SELECT area, x0 + {HOLE[0]}e0 AS x0, y0 + {HOLE[1]}e0 AS y0, x0 + {HOLE[2]}e0 AS x1, y0 + {HOLE[3]}e0 AS y1 FROM boxes),
z AS (SELECT area AS zone, x0 + {EAST}e0 AS x0, y0 + {NORTH}e0 AS y0, x1 + {EAST}e0 AS x1, y1 + {NORTH}e0 AS y1 FROM boxes)
SELECT a.area, zone, round(({_SHARED} - {_HOLE_SHARED}) * 1e6, 3) AS size,
       CAST(h.x0 > z.x0 AND h.x1 < z.x1 AND h.y0 > z.y0 AND h.y1 < z.y1 AS BIGINT) AS holes, true AS valid
FROM boxes a JOIN holes h USING (area) JOIN z ON {_SHARED} - {_HOLE_SHARED} > 1e-12""",
    "repaired_outlines": """SELECT p_partkey, p_partkey % 4 = 0 AS was_valid,
       round(p_size * 0.001e0 * (p_partkey % 7 + 1) * 0.002e0 * CASE p_partkey % 4 WHEN 1 THEN 0.5e0 WHEN 3 THEN 2e0 ELSE 1e0 END * 1e6, 3) AS size, true AS valid
FROM part""",
    "dissolved_regions": f"""WITH {BOXES_SQL}, b AS (SELECT boxes.*, n_regionkey FROM boxes JOIN nation ON n_nationkey = area),
xs AS (SELECT x, lead(x) OVER (ORDER BY x) AS x2 FROM (SELECT x0 AS x FROM b UNION SELECT x1 FROM b)),
ys AS (SELECT y, lead(y) OVER (ORDER BY y) AS y2 FROM (SELECT y0 AS y FROM b UNION SELECT y1 FROM b))
SELECT n_regionkey, round(sum((x2 - x) * (y2 - y)) * 1e6, 3) AS size, true AS valid
FROM (SELECT DISTINCT n_regionkey, x, x2, y, y2 FROM b JOIN xs ON x0 <= x AND x2 <= x1 JOIN ys ON y0 <= y AND y2 <= y1) GROUP BY 1""",
    "nearest_park": f"""WITH {BUILDINGS_SQL}, {BOXES_SQL}, parks AS (
  SELECT area AS park, x0 + {PARK[0]}e0 AS x0, y0 + {PARK[1]}e0 AS y0, x0 + {PARK[2]}e0 AS x1, y0 + {PARK[3]}e0 AS y1 FROM boxes
), d AS (
  SELECT c_custkey, park, park % {PLANNED} = 0 AS planned,
         sqrt(pow(greatest(x0 - lon, 0, lon - x1) * radians(1) * 6378137e0 / sqrt({_W}) * cos(radians(lat)), 2)
              + pow(greatest(y0 - lat, 0, lat - y1) * radians(1) * 6378137e0 * (1 - 0.0066943799901413165e0) / ({_W} * sqrt({_W})), 2)) AS m
  FROM buildings JOIN parks ON true
), n AS (
  SELECT c_custkey, min({{'m': m, 'park': park}}) FILTER (NOT planned) AS a, min({{'m': m, 'park': park}}) FILTER (planned) AS b FROM d GROUP BY 1
)
SELECT c_custkey, CASE WHEN a.m <= b.m + 300 THEN a.park ELSE b.park END AS park, a.m <= b.m + 300 AS existing,
       CAST(round(CASE WHEN a.m <= b.m + 300 THEN a.m ELSE b.m END) AS BIGINT) AS metres FROM n""",
    "simplified_borders": """WITH n AS (SELECT n_nationkey AS area, n_nationkey % 5 AS i, n_nationkey // 5 AS j FROM nation),
b AS (SELECT area, ((i + 1) * 7 + j * 3) % 5 AS east, (i * 7 + j * 3) % 5 AS west, (i * 3 + (j + 1) * 7) % 5 AS north, (i * 3 + j * 7) % 5 AS south FROM n),
k AS (SELECT area, unnest([east, west, north, south]) AS bend, unnest([0.04e0, -0.04e0, 0.045e0, -0.045e0]) AS part FROM b)
SELECT area, 5 + count(*) FILTER (bend > 2) AS points, round((0.0072e0 + sum(CASE WHEN bend > 2 THEN part * bend * 0.001e0 ELSE 0e0 END)) * 1e6, 3) AS size FROM k GROUP BY 1""",
}
