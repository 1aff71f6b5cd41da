"""Shapes made of other shapes' edges: what two share, what either covers, repair, validity.

All edges are cut where they meet. Of each piece it is known on which side each shape lies, by how
many pieces a ray from its middle crosses, so a rule on the sides says which pieces bound the result
and which way round. Walks that keep the inside on their left, parted where they come to a point
twice, give its rings. Inside is what an odd number of a shape's edges surround, so holes, parts and
crossing rings need no cases of their own.

The work of one shape, or of one pair, is numpy in a task; Spark pairs them and deals them out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

#: Places are whole multiples of this, in degrees: a hundredth of a millimetre.
GRID = 1e-10
#: Cuts make new places on the grid, so edges are cut again until none is; a few rounds at most.
ROUNDS = 12
#: Pairs of edges that are compared at once.
AT_ONCE = 1 << 21

Rings = list[np.ndarray]
PIECES = StructType([StructField("xs", ArrayType(DoubleType())), StructField("ys", ArrayType(DoubleType())), StructField("sizes", ArrayType(IntegerType()))])


def _edges(rings: Rings) -> np.ndarray:
    """The edges (x0, y0, x1, y1) of rings on the grid, without those of no length. Rings are closed if they are not."""
    found = [np.zeros((0, 4))]
    for ring in rings:
        points = np.round(np.asarray(ring, float).reshape(-1, 2) / GRID)
        if len(points):
            found.append(np.hstack([points, np.roll(points, -1, 0)]))
    edges = np.concatenate(found)
    return edges[(edges[:, :2] != edges[:, 2:]).any(1)]


def _meeting(edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of edges whose bounds meet."""
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    step = max(1, AT_ONCE // max(1, len(edges)))
    for a in range(0, len(edges), step):
        some = slice(a, a + step)
        near = ((low[some, None] <= high[None]) & (high[some, None] >= low[None])).all(2)
        i, j = np.nonzero(near)
        i += a
        yield i[i < j], j[i < j]


def _cross(o: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p[:, 0] - o[:, 0]) * (q[:, 1] - o[:, 1]) - (p[:, 1] - o[:, 1]) * (q[:, 0] - o[:, 0])


def _on(edge: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether places lie on edges, to within a step of the grid, and not at their ends."""
    a, d = edge[:, :2], edge[:, 2:] - edge[:, :2]
    along = ((at - a) * d).sum(1)
    length2 = (d * d).sum(1)
    off = np.abs((at[:, 0] - a[:, 0]) * d[:, 1] - (at[:, 1] - a[:, 1]) * d[:, 0])
    inner = (along > 0) & (along < length2) & (off <= 0.75 * np.sqrt(length2))
    return inner & (at != a).any(1) & (at != edge[:, 2:]).any(1)


def _cuts(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, place) where edges have to be cut."""
    at_edge, places = [np.zeros(0, np.int64)], [np.zeros((0, 2))]
    for i, j in _meeting(edges):
        e, f = edges[i], edges[j]
        for own, edge, other in ((i, e, f), (j, f, e)):
            for end in (other[:, :2], other[:, 2:]):
                on = _on(edge, end)
                at_edge.append(own[on])
                places.append(end[on])
        a, b = _cross(e[:, :2], e[:, 2:], f[:, :2]), _cross(e[:, :2], e[:, 2:], f[:, 2:])
        c, d = _cross(f[:, :2], f[:, 2:], e[:, :2]), _cross(f[:, :2], f[:, 2:], e[:, 2:])
        across = (np.sign(a) * np.sign(b) < 0) & (np.sign(c) * np.sign(d) < 0)
        if across.any():
            t = (c[across] / (c[across] - d[across]))[:, None]
            at = np.round(e[across, :2] + t * (e[across, 2:] - e[across, :2]))
            for own, edge in ((i[across], e[across]), (j[across], f[across])):
                inner = (at != edge[:, :2]).any(1) & (at != edge[:, 2:]).any(1)
                at_edge.append(own[inner])
                places.append(at[inner])
    return np.concatenate(at_edge), np.concatenate(places)


def _noded(edges: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges cut at all places where they meet, each with its owner."""
    for _ in range(ROUNDS):
        at, places = _cuts(edges)
        if not len(at):
            break
        along = ((places - edges[at, :2]) * (edges[at, 2:] - edges[at, :2])).sum(1)
        every = np.arange(len(edges))
        of = np.r_[every, at, every]
        points = np.concatenate([edges[:, :2], places, edges[:, 2:]])
        order = np.lexsort((np.r_[np.full(len(edges), -np.inf), along, np.full(len(edges), np.inf)], of))
        of, points = of[order], points[order]
        same = of[1:] == of[:-1]
        pieces = np.hstack([points[:-1], points[1:]])[same]
        real = (pieces[:, :2] != pieces[:, 2:]).any(1)
        edges, owner = pieces[real], owner[of[:-1][same][real]]
    return edges, owner


def _turned(edges: np.ndarray) -> np.ndarray:
    """Edges from their lower to their upper end, level ones from west to east."""
    back = (edges[:, 1] > edges[:, 3]) | ((edges[:, 1] == edges[:, 3]) & (edges[:, 0] > edges[:, 2]))
    return np.where(back[:, None], edges[:, [2, 3, 0, 1]], edges)


def _sides(edges: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cut edge and each owner whether its left and its right side are inside; ``odd``: whether the edge is the owner's."""
    left = np.zeros(odd.shape, bool)
    level = edges[:, 1] == edges[:, 3]
    middle = (edges[:, :2] + edges[:, 2:]) / 2
    step = max(1, AT_ONCE // max(1, len(edges)))
    for axis, rows in ((0, np.flatnonzero(~level)), (1, np.flatnonzero(level))):  # a ray east, or north from a level edge
        run, over = 1 - axis, axis
        low, high = np.minimum(edges[:, run], edges[:, run + 2]), np.maximum(edges[:, run], edges[:, run + 2])
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (edges[:, over + 2] - edges[:, over]) / (edges[:, run + 2] - edges[:, run])
        for k in range(0, len(rows), step):
            e = rows[k : k + step]
            at = middle[e, run][:, None]
            met = (low[None] <= at) & (high[None] > at)
            with np.errstate(invalid="ignore"):
                met &= edges[None, :, over] + slope[None] * (at - edges[None, :, run]) > middle[e, over][:, None]
            met[np.arange(len(e)), e] = False
            beyond = (met.astype(np.float32) @ odd.astype(np.float32)).astype(np.int64) % 2 == 1
            # East is right of an edge that rises; north is left of a level one.
            left[e] = beyond ^ odd[e] if axis == 0 else beyond
    return left, left ^ odd


def _walks(edges: np.ndarray) -> list[list[tuple[float, float]]]:
    """Rings of directed edges that have their inside on the left, parted where one comes to a place twice."""
    leaving = defaultdict(list)
    for x0, y0, x1, y1 in edges.tolist():
        leaving[x0, y0].append((x1, y1))
    rings = []

    def next_of(before: tuple, at: tuple) -> tuple:
        """The first way on, clockwise from the way back: it keeps to the same inside."""
        ways = leaving[at]
        if len(ways) == 1:
            return ways.pop()
        back = np.arctan2(before[1] - at[1], before[0] - at[0])
        turn = [(back - np.arctan2(w[1] - at[1], w[0] - at[0])) % (2 * np.pi) or 2 * np.pi for w in ways]
        return ways.pop(int(np.argmin(turn)))

    for start in list(leaving):
        while leaving[start]:
            path, seen = [start], {start: 0}
            at, before = leaving[start].pop(), start
            while True:
                if at in seen:
                    k = seen[at]
                    rings.append(path[k:])
                    for p in path[k + 1 :]:
                        del seen[p]
                    path = path[: k + 1]
                    if not k:
                        break
                else:
                    seen[at] = len(path)
                    path.append(at)
                at, before = next_of(before, at), at
    return rings


def _area2(ring: np.ndarray) -> float:
    p = ring - ring[0]
    return float((p[:, 0] * np.roll(p[:, 1], -1) - p[:, 1] * np.roll(p[:, 0], -1)).sum())


def _holds(ring: np.ndarray, at: np.ndarray) -> bool:
    """Whether a place that is not on a ring is in it."""
    a, b = ring, np.roll(ring, -1, 0)
    met = (a[:, 1] <= at[1]) != (b[:, 1] <= at[1])
    a, b = a[met], b[met]
    return bool((a[:, 0] + (at[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]) > at[0]).sum() % 2)


def _polygons(walks: list) -> Rings:
    """Closed rings in degrees: outer ones, largest first, each followed by its holes; from the least place on."""
    rings = []
    for walk in walks:
        ring = np.array(walk)
        ring = np.roll(ring, -np.lexsort((ring[:, 1], ring[:, 0]))[0], 0)
        rings.append((_area2(ring), ring))
    outer = sorted((r for r in rings if r[0] > 0), key=lambda r: (-r[0], r[1].tolist()))
    holes = [[] for _ in outer]
    for area, ring in sorted((r for r in rings if r[0] < 0), key=lambda r: (r[0], r[1].tolist())):
        at = (ring[0] + ring[1]) / 2
        around = [k for k, (size, o) in enumerate(outer) if size > -area and _holds(o, at)]
        if around:
            holes[around[-1]].append(ring)
    ordered = [r for (_, o), inner in zip(outer, holes, strict=True) for r in (o, *inner)]
    return [np.concatenate([r, r[:1]]) * GRID for r in ordered]


def arranged(shapes: Sequence[Rings], inside: Callable[[np.ndarray], np.ndarray]) -> Rings:
    """The shape of what is inside by ``inside``, a rule on whether each of ``shapes`` is there."""
    parts = [_edges(s) for s in shapes]
    edges, owner = _noded(np.concatenate(parts), np.repeat(np.arange(len(parts)), list(map(len, parts))))
    if not len(edges):
        return []
    edges, place = np.unique(_turned(edges), axis=0, return_inverse=True)
    times = np.zeros((len(edges), len(parts)), np.int64)
    np.add.at(times, (place.ravel(), owner), 1)
    odd = times % 2 == 1
    edges, odd = edges[odd.any(1)], odd[odd.any(1)]
    left, right = _sides(edges, odd)
    left, right = inside(left), inside(right)
    up, down = edges[left & ~right], edges[right & ~left]
    return _polygons(_walks(np.concatenate([up, down[:, [2, 3, 0, 1]]])))


def both(inside: np.ndarray) -> np.ndarray:
    return inside.all(1)


def either(inside: np.ndarray) -> np.ndarray:
    return inside.any(1)


def first_only(inside: np.ndarray) -> np.ndarray:
    return inside[:, 0] & ~inside[:, 1:].any(1)


def one_only(inside: np.ndarray) -> np.ndarray:
    return inside.sum(1) == 1


def is_valid(rings: Rings) -> bool:
    """Whether rings make a proper shape: outer ones that turn left, each followed by its holes.

    Rings are closed and have three places at least, none crosses, touches or runs back along itself,
    two rings meet at single places only and not so that they part the inside, a hole is in its outer
    ring and in no other hole, and parts do not overlap. A shape without rings is proper.
    """
    rounded = [np.round(np.asarray(r, float).reshape(-1, 2) / GRID) for r in rings]
    if any(len(r) < 4 or (r[0] != r[-1]).any() for r in rounded):
        return False
    open_ = [r[:-1] for r in rounded]
    if any(len(np.unique(r, axis=0)) < len(r) for r in open_):
        return False
    parts = [np.hstack([r[:-1], r[1:]]) for r in rounded]
    edges, owner = np.concatenate([np.zeros((0, 4)), *parts]), np.repeat(np.arange(len(parts)), list(map(len, parts)))
    cut, of = _noded(edges, owner)
    if len(np.unique(_turned(cut), axis=0)) < len(cut):
        return False
    at_place = defaultdict(set)
    degree = defaultdict(int)
    for (x, y), ring in zip(cut[:, :2].tolist(), of.tolist(), strict=True):
        at_place[x, y].add(ring)
        degree[x, y, ring] += 1
    vertices = [set(map(tuple, r.tolist())) for r in open_]
    if any(n > 1 for n in degree.values()) or any(not any(p in vertices[r] for r in met) for p, met in at_place.items() if len(met) > 1):
        return False
    # Rings that cross at a place go through each other there: their middles lie on both sides.
    middles = [(c[:, :2] + c[:, 2:]) / 2 for c in (cut[of == k] for k in range(len(parts)))]
    within = lambda k, o: [_holds(open_[o], m) for m in middles[k]]
    outer, current = [], None
    for k, ring in enumerate(open_):
        if _area2(ring) > 0 or current is None:
            current = k
        outer.append(current)
    for k in range(len(parts)):
        for o in range(len(parts)):
            if k == o:
                continue
            found = within(k, o)
            if any(found) != all(found):
                return False
            holed = outer[k] != k
            if holed and o == outer[k] and not all(found) or holed and outer[o] == outer[k] and o != outer[k] and any(found):
                return False
            if not holed and outer[o] == o and any(found):  # a part in another part must be in one of its holes
                if not any(outer[h] == o and h != o and all(within(k, h)) for h in range(len(parts))):
                    return False
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for place, met in at_place.items():
        for k in met if len({(outer[r]) for r in met}) < len(met) else ():
            a, b = find(("place", place)), find(k)
            if a == b:
                return False
            root[a] = b
    return True


def _split(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> Rings:
    return np.split(np.stack([x, y], 1), np.cumsum(n)[:-1]) if x is not None and len(x) else []


def flat_rings(rings: Rings) -> tuple[np.ndarray, np.ndarray, list[int]]:
    points = np.concatenate([np.zeros((0, 2)), *rings])
    return points[:, 0], points[:, 1], list(map(len, rings))


def _frame(shapes: list[Rings]) -> pd.DataFrame:
    return pd.DataFrame([flat_rings(s) for s in shapes], columns=["xs", "ys", "sizes"])


def _of_two(rule: Callable):
    @F.pandas_udf(PIECES)
    def made(ax: pd.Series, ay: pd.Series, an: pd.Series, bx: pd.Series, by: pd.Series, bn: pd.Series) -> pd.DataFrame:
        return _frame([arranged([_split(*v[:3]), _split(*v[3:])], rule) for v in zip(ax, ay, an, bx, by, bn, strict=True)])

    return made


@F.pandas_udf(PIECES)
def _repaired(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.DataFrame:
    return _frame([arranged([_split(*v)], either) for v in zip(x, y, n, strict=True)])


@F.pandas_udf(BooleanType())
def _valid(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([is_valid(_split(*v)) for v in zip(x, y, n, strict=True)])


def pieces_of(rings: Column) -> list[Column]:
    """Rings as all their x, all their y and the points of each, which is what Python takes."""
    points = F.flatten(rings)
    return [F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]), F.transform(rings, F.size)]


def rings_of(pieces: Column) -> Column:
    """Rings of such pieces. ``pieces`` must be a column of a DataFrame."""
    sizes = pieces["sizes"]
    start = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda s, n: s + n)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    points = F.zip_with(pieces["xs"], pieces["ys"], point)
    return F.transform(sizes, lambda n, i: F.slice(points, start(i) + 1, n))


def shape_of_two(a: Column, b: Column, rule: Callable = both) -> Column:
    """Pieces of the shape that ``rule`` makes of two columns of rings; see ``rings_of``."""
    return _of_two(rule)(*pieces_of(a), *pieces_of(b))


def repaired(rings: Column) -> Column:
    """Pieces of the proper shape that covers what an odd number of the edges of ``rings`` surround."""
    return _repaired(*pieces_of(rings))


def valid(rings: Column) -> Column:
    """``is_valid`` of a column of rings; a null is not valid."""
    return F.when(rings.isNotNull(), _valid(*pieces_of(F.coalesce(rings, F.array().cast("array<array<struct<x: double, y: double>>>"))))).otherwise(False)
