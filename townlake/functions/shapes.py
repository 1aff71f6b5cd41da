"""Measures and projections of shapes as column expressions.

A polygon is ``rings``: an array of closed rings of structs (x, y) in degrees. Each outer ring
turns left and is followed by its holes, which turn right.
"""

from __future__ import annotations

from math import atanh, cos, log, pi, radians, sin, sqrt, tan

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType

from townlake.functions.geo import ECCENTRICITY_2, FLATTENING, SEMI_MAJOR_M, distance_m

ECCENTRICITY = sqrt(ECCENTRICITY_2)
#: Transverse Mercator of the UTM zones, and the conic of EPSG 7801 (fixed values).
UTM_SCALE, UTM_EAST = 0.9996, 500_000.0
CONIC_SOUTH, CONIC_NORTH, CONIC_LAT, CONIC_LON = 42.0, 43.0 + 1 / 3, 42.6678756833333, 25.5
CONIC_EAST_M, CONIC_NORTH_M = 500_000.0, 4_725_824.3591


def edges(ring: Column) -> Column:
    """The edges (a, b) of a ring or line."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))
    return F.when(F.size(ring) > 1, pairs).otherwise(F.slice(pairs, 1, 0))


def _cross(e: Column, at: Column) -> Column:
    return (e["a"]["x"] - at["x"]) * (e["b"]["y"] - at["y"]) - (e["b"]["x"] - at["x"]) * (e["a"]["y"] - at["y"])


def signed_area(ring: Column) -> Column:
    """Planar area, above zero for a ring that turns left."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + _cross(e, F.get(ring, F.lit(0)))) / 2


def _equal_area_y(lat: Column) -> Column:
    s = F.sin(F.radians(lat)) * ECCENTRICITY
    q = (1 - ECCENTRICITY_2) * (s / ECCENTRICITY / (1 - s * s) - F.log((1 - s) / (1 + s)) / (2 * ECCENTRICITY))
    return q * SEMI_MAJOR_M / 2


def area_m2(rings: Column) -> Column:
    """Square metres on the ellipsoid, by an equal-area cylinder."""
    flat = lambda p: F.struct((F.radians(p["x"]) * SEMI_MAJOR_M).alias("x"), _equal_area_y(p["y"]).alias("y"))
    return F.aggregate(rings, F.lit(0.0), lambda s, ring: s + signed_area(F.transform(ring, flat)))


def length_m(line: Column) -> Column:
    """Metres along an array of points."""
    return F.aggregate(edges(line), F.lit(0.0), lambda s, e: s + distance_m(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))


def centroid(rings: Column) -> Column:
    """The centre of mass as struct (x, y)."""
    origin = F.get(F.get(rings, F.lit(0)), F.lit(0))
    every = F.flatten(F.transform(rings, edges))
    twice = F.aggregate(every, F.lit(0.0), lambda s, e: s + _cross(e, origin))
    moment = lambda k: F.aggregate(every, F.lit(0.0), lambda s, e: s + (e["a"][k] + e["b"][k] - 2 * origin[k]) * _cross(e, origin))
    return F.struct(*[(origin[k] + moment(k) / (3 * twice)).alias(k) for k in ("x", "y")])


def metres_to_edges(rings: Column, lon: Column, lat: Column) -> Column:
    """Metres from a point to the nearest edge of ``rings``, on a plane at the point."""
    s = F.sin(F.radians(lat))
    w = 1 - ECCENTRICITY_2 * s * s
    east = F.radians(F.lit(1.0)) * SEMI_MAJOR_M / F.sqrt(w) * F.cos(F.radians(lat))
    north = F.radians(F.lit(1.0)) * SEMI_MAJOR_M * (1 - ECCENTRICITY_2) / (w * F.sqrt(w))

    # Each step is a list of its own, so that what is used twice is worked out once.
    def seen(p: Column) -> Column:
        def vector(e: Column) -> Column:
            ax, ay = (e["a"]["x"] - p["lon"]) * p["east"], (e["a"]["y"] - p["lat"]) * p["north"]
            dx, dy = (e["b"]["x"] - e["a"]["x"]) * p["east"], (e["b"]["y"] - e["a"]["y"]) * p["north"]
            return F.struct(ax.alias("ax"), ay.alias("ay"), dx.alias("dx"), dy.alias("dy"))

        def foot(v: Column) -> Column:
            ax, ay, dx, dy = (v[c] for c in ("ax", "ay", "dx", "dy"))
            long2 = dx * dx + dy * dy
            t = F.when(long2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(long2, F.lit(0.0))))).otherwise(0.0)
            return F.struct(v.alias("v"), t.alias("t"))

        def apart(f: Column) -> Column:
            x, y = f["v"]["ax"] + f["t"] * f["v"]["dx"], f["v"]["ay"] + f["t"] * f["v"]["dy"]
            return F.sqrt(x * x + y * y)

        return F.array_min(F.transform(F.transform(F.transform(F.flatten(F.transform(rings, edges)), vector), foot), apart))

    place = F.struct(lon.alias("lon"), lat.alias("lat"), east.alias("east"), north.alias("north"))
    return F.get(F.transform(F.array(place), seen), F.lit(0))


def rings_of_geojson(geometry: Column) -> Column:
    """The rings of a GeoJSON Polygon or MultiPolygon text, turned as they should be; else null."""
    kind, found = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    ring_type = "array<array<array<double>>>"
    parts = F.when(kind == "Polygon", F.array(F.from_json(found, ring_type))).when(kind == "MultiPolygon", F.from_json(found, f"array<{ring_type}>"))

    def turned(ring: Column, i: Column) -> Column:
        points = F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
        return F.when((signed_area(points) > 0) == (i == 0), points).otherwise(F.reverse(points))

    return F.flatten(F.transform(parts, lambda part: F.transform(part, turned)))


def geojson_of_rings(rings: Column, digits: int = 6) -> Column:
    """A GeoJSON MultiPolygon text with rounded coordinates."""
    point = lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))
    coordinates = F.transform(rings, lambda ring: F.struct((signed_area(ring) > 0).alias("outer"), F.transform(ring, point).alias("ring")))
    none = F.array().cast("array<array<array<array<double>>>>")
    grow = lambda acc, r: F.when(r["outer"] | (F.size(acc) == 0), F.concat(acc, F.array(F.array(r["ring"])))).otherwise(
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.array(r["ring"]))))
    )
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.aggregate(coordinates, none, grow).alias("coordinates")))


def tile_place(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web Mercator place in tiles of ``zoom``: the whole part is the tile, the rest the place in it."""
    x = (lon + 180) / 360
    y = F.lit(0.5) - F.log(F.tan(F.lit(pi / 4) + F.radians(lat) / 2)) / (2 * pi)
    return x * 2.0**zoom, y * 2.0**zoom


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing in a northern UTM zone, to less than a millimetre within it."""
    n = FLATTENING / (2 - FLATTENING)
    scale = UTM_SCALE * SEMI_MAJOR_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    across, s = F.radians(lon - (zone * 6 - 183)), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - ECCENTRICITY * F.atanh(s * ECCENTRICITY))
    up, side = F.atan2(t, F.cos(across)), F.atanh(F.sin(across) / F.sqrt(1 + t * t))
    east = side + sum(a * F.cos(2 * j * up) * F.sinh(2 * j * side) for j, a in enumerate(series, 1))
    north = up + sum(a * F.sin(2 * j * up) * F.cosh(2 * j * side) for j, a in enumerate(series, 1))
    return east * scale + UTM_EAST, north * scale


def _conic() -> tuple[float, float, float]:
    """Cone constant, scale and the radius at the origin."""
    m = lambda d: cos(radians(d)) / sqrt(1 - ECCENTRICITY_2 * sin(radians(d)) ** 2)
    t = lambda d: tan(pi / 4 - radians(d) / 2) * np.exp(ECCENTRICITY * atanh(ECCENTRICITY * sin(radians(d))))
    n = (log(m(CONIC_SOUTH)) - log(m(CONIC_NORTH))) / (log(t(CONIC_SOUTH)) - log(t(CONIC_NORTH)))
    scale = SEMI_MAJOR_M * m(CONIC_SOUTH) / (n * t(CONIC_SOUTH) ** n)
    return n, scale, float(scale * t(CONIC_LAT) ** n)


def conic(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in EPSG 7801."""
    n, scale, origin = _conic()
    phi = F.radians(lat)
    t = F.tan(F.lit(pi / 4) - phi / 2) * F.exp(ECCENTRICITY * F.atanh(ECCENTRICITY * F.sin(phi)))
    r, angle = scale * F.pow(t, F.lit(n)), F.radians(lon - CONIC_LON) * n
    return CONIC_EAST_M + r * F.sin(angle), CONIC_NORTH_M + origin - r * F.cos(angle)


def from_conic(east: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a place in EPSG 7801."""
    n, scale, origin = _conic()
    x, y = east - CONIC_EAST_M, F.lit(origin + CONIC_NORTH_M) - north
    t = F.pow(F.sqrt(x * x + y * y) / scale, F.lit(1 / n))
    phi = F.lit(pi / 2) - 2 * F.atan(t)
    for _ in range(6):  # each step is about 300 times nearer
        phi = F.lit(pi / 2) - 2 * F.atan(t * F.exp(-ECCENTRICITY * F.atanh(ECCENTRICITY * F.sin(phi))))
    return F.degrees(F.atan2(x, y) / n) + CONIC_LON, F.degrees(phi)


def _rising(xs: np.ndarray, ys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Edges (x0, y0, x1, y1) of rings, each from its lower end, without level ones."""
    ends = np.cumsum(sizes)
    first = np.ones(len(xs), bool)
    first[ends - 1] = False
    i = np.flatnonzero(first)
    e = np.stack([xs[i], ys[i], xs[i + 1], ys[i + 1]], 1)
    e[e[:, 1] > e[:, 3]] = e[e[:, 1] > e[:, 3]][:, [2, 3, 0, 1]]
    return e[e[:, 1] < e[:, 3]]


def shared_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area that two polygons share, given as rising edges.

    Between the heights at which edges end or cross, all edges run apart, so the shared width at
    a slab's middle times its height is its area.
    """
    if not len(a) or not len(b):
        return 0.0
    low, high = max(a[:, 1].min(), b[:, 1].min()), min(a[:, 3].max(), b[:, 3].max())
    a, b = (e[(e[:, 1] < high) & (e[:, 3] > low)] for e in (a, b))
    slope = lambda e: (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    ka, kb = slope(a), slope(b)
    heights = [np.array([low, high]), a[:, 1], a[:, 3], b[:, 1], b[:, 3]]
    for e, k in zip(a, ka, strict=True):
        with np.errstate(divide="ignore", invalid="ignore"):
            y = e[1] + (b[:, 0] + kb * (e[1] - b[:, 1]) - e[0]) / (k - kb)
        heights.append(y[(y > np.maximum(e[1], b[:, 1])) & (y < np.minimum(e[3], b[:, 3]))])
    ys = np.unique(np.clip(np.concatenate(heights), low, high))
    area = 0.0
    for y0, y1 in zip(ys[:-1], ys[1:], strict=True):
        m = (y0 + y1) / 2
        at = [np.sort(e[on, 0] + k[on] * (m - e[on, 1])) for e, k in ((a, ka), (b, kb)) for on in [(e[:, 1] < m) & (e[:, 3] > m)]]
        starts, stops = np.maximum(at[0][::2, None], at[1][None, ::2]), np.minimum(at[0][1::2, None], at[1][None, 1::2])
        area += float(np.clip(stops - starts, 0, None).sum()) * (y1 - y0)
    return area


@F.pandas_udf(DoubleType())
def _shared(ax: pd.Series, ay: pd.Series, an: pd.Series, bx: pd.Series, by: pd.Series, bn: pd.Series) -> pd.Series:
    return pd.Series([shared_area(_rising(*v[:3]), _rising(*v[3:])) for v in zip(ax, ay, an, bx, by, bn, strict=True)], dtype="float64")


def overlap_area(a: Column, b: Column) -> Column:
    """Planar area that two polygons share, holes and several parts included.

    Both must be columns of a DataFrame, not expressions: Spark can't hand lambdas in lambdas on.
    """
    flat = lambda rings: [F.transform(F.flatten(rings), lambda p: p["x"]), F.transform(F.flatten(rings), lambda p: p["y"]), F.transform(rings, F.size)]
    return _shared(*flat(a), *flat(b))


def thinned(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay so that none that goes is farther than ``tolerance`` from it."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    if len(line) > 3 and (line[0] == line[-1]).all():  # a ring turns at the point farthest from its start
        far = int(np.hypot(*(line - line[0]).T).argmax())
        keep[far] = True
        todo = [(0, far), (far, len(line) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d, p = line[j] - line[i], line[i + 1 : j] - line[i]
        t = np.clip(p @ d / (d @ d), 0, 1) if d.any() else np.zeros(len(p))
        off = np.hypot(*(p - t[:, None] * d).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


@F.pandas_udf(ArrayType(BooleanType()))
def _kept(xs: pd.Series, ys: pd.Series, sizes: pd.Series, tolerance: pd.Series) -> pd.Series:
    out = []
    for x, y, n, t in zip(xs, ys, sizes, tolerance, strict=True):
        parts = [thinned(line, t) for line in np.split(np.stack([x, y], 1), np.cumsum(n)[:-1])]
        out.append(np.concatenate([k if k.sum() > 3 else np.ones(len(k), bool) for k in parts]))
    return pd.Series(out)


def kept_points(rings: Column, tolerance: float) -> Column:
    """For each point of all rings whether it stays; ``rings`` must be a column, as it is in ``overlap_area``."""
    points, sizes = F.flatten(rings), F.transform(rings, F.size)
    return _kept(F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]), sizes, F.lit(tolerance))
