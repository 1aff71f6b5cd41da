"""Vector tiles: features cut to Web Mercator tiles and encoded, one blob a tile."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townlake.functions.shapes import tile_place

#: Units across a tile, and how far shapes reach over its border (fixed values).
EXTENT, BUFFER = 4096, 16
#: Kinds of geometry and commands of the tile format (fixed values).
POINT, POLYGON = 1, 3
MOVE, LINE, CLOSE = 1, 2, 7


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, body: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(body)) + body


def _number(number: int, n: int) -> bytes:
    return varint(number << 3) + varint(n)


def _value(value: object) -> bytes:
    if isinstance(value, str):
        return _field(1, value.encode())
    if isinstance(value, (bool, np.bool_)):
        return _number(7, int(value))
    if isinstance(value, (int, np.integer)):
        return _number(4, int(value) & (1 << 64) - 1)
    return varint(3 << 3 | 1) + struct.pack("<d", value)


def geometry_commands(kind: int, rings: Sequence[np.ndarray]) -> list[int]:
    """Commands of rings (or of one point) in whole tile units."""
    zigzag = lambda n: n << 1 ^ n >> 63
    out, at = [], (0, 0)
    for ring in rings:
        for k, (x, y) in enumerate(ring.tolist()):
            if k == 0:
                out.append(MOVE | 1 << 3)
            elif k == 1:
                out.append(LINE | (len(ring) - 1) << 3)
            out += [zigzag(x - at[0]), zigzag(y - at[1])]
            at = (x, y)
        if kind == POLYGON:
            out.append(CLOSE | 1 << 3)
    return out


def encode_tile(layer: str, features: Iterable[tuple[int, dict, int, list[int]]]) -> bytes:
    """A tile of one layer from (id, properties, kind, commands); null properties are left out."""
    keys: dict[str, int] = {}
    values: dict[tuple, int] = {}
    body = _field(1, layer.encode())
    for fid, properties, kind, commands in features:
        tags = []
        for name, value in properties.items():
            if value is not None and value == value:
                tags += [keys.setdefault(name, len(keys)), values.setdefault((type(value), value), len(values))]
        parts = _number(1, fid) + _field(2, b"".join(map(varint, tags))) + _number(3, kind) + _field(4, b"".join(map(varint, commands)))
        body += _field(2, parts)
    body += b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _value(v)) for _, v in values)
    return _field(3, body + _number(5, EXTENT) + _number(15, 2))


def clipped(ring: np.ndarray, low: float, high: float) -> np.ndarray:
    """An open ring cut to the square from ``low`` to ``high``, side by side."""
    for axis, bound, sign in ((0, low, 1), (0, high, -1), (1, low, 1), (1, high, -1)):
        if not len(ring):
            return ring
        inside = (ring[:, axis] - bound) * sign >= 0
        before, was = np.roll(ring, 1, 0), np.roll(inside, 1)
        out = []
        for p, q, now, then in zip(ring, before, inside, was, strict=True):
            if now != then:
                out.append(q + (p - q) * ((bound - q[axis]) / (p[axis] - q[axis])))
            if now:
                out.append(p)
        ring = np.array(out).reshape(-1, 2)
    return ring


def tile_points(rows: DataFrame, zoom: int) -> DataFrame:
    """Add the tile (z, x, y) of each point and its place (px, py) in it."""
    at_x, at_y = tile_place(F.col("lon"), F.col("lat"), zoom)
    place = lambda at: F.floor((at - F.floor(at)) * EXTENT).cast("int")
    return rows.withColumns({"z": F.lit(zoom), "x": F.floor(at_x).cast("int"), "y": F.floor(at_y).cast("int"), "px": place(at_x), "py": place(at_y)})


def tile_polygons(rows: DataFrame, zoom: int) -> DataFrame:
    """One row for each tile that the bounds of ``rings``, with the buffer, reach into."""
    margin = BUFFER / EXTENT
    point = lambda p: F.struct(*[at.alias(k) for at, k in zip(tile_place(p["x"], p["y"], zoom), ("x", "y"), strict=True)])
    placed = rows.withColumn("_in_tiles", F.transform("rings", lambda ring: F.transform(ring, point)))

    def reach(axis: str):
        values = F.transform(F.flatten("_in_tiles"), lambda p: p[axis])
        return F.explode(F.sequence(F.floor(F.array_min(values) - margin).cast("int"), F.floor(F.array_max(values) + margin).cast("int")))

    return placed.withColumn("x", reach("x")).withColumn("y", reach("y")).withColumn("z", F.lit(zoom))


def vector_tiles(rows: DataFrame, fid: str, properties: Sequence[str], zoom: int, layer: str) -> DataFrame:
    """(z, x, y, tile, features): the encoded tiles of points (lon, lat) or polygons (``rings``).

    A tile is one blob, so its features meet in one task: choose a zoom at which a tile's ground,
    and so its features, are few. Features are in the order of their ids.
    """
    names = list(properties)
    if "rings" in rows.columns:
        placed = tile_polygons(rows, zoom).select("z", "x", "y", fid, *names, F.col("_in_tiles").alias("_shape"))
    else:
        shape = F.array(F.array(F.struct(F.col("px").alias("x"), F.col("py").alias("y"))))
        placed = tile_points(rows, zoom).select("z", "x", "y", fid, *names, shape.alias("_shape"))
    kind = POLYGON if "rings" in rows.columns else POINT

    def encode(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        features = []
        for row in group.sort_values(fid).to_dict("records"):
            rings = [np.array([(p["x"], p["y"]) for p in ring], float) for ring in row["_shape"]]
            if kind == POLYGON:
                cut = [clipped((ring[:-1] - key[1:]) * EXTENT, -BUFFER, EXTENT + BUFFER) for ring in rings]
                rings = [ring for ring in (np.round(c) for c in cut) if len(np.unique(ring, axis=0)) > 2]
            if rings:
                commands = geometry_commands(kind, [r.astype(int) for r in rings])
                features.append((int(row[fid]), {n: row[n] for n in names}, kind, commands))
        blob = encode_tile(layer, features)
        return pd.DataFrame({"z": [key[0]], "x": [key[1]], "y": [key[2]], "tile": [blob], "features": [len(features)]})

    tiles = placed.groupBy("z", "x", "y").applyInPandas(encode, "z int, x int, y int, tile binary, features int")
    return tiles.where("features > 0")
