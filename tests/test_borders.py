"""Common borders stay common when shapes get fewer points."""

import math
import random

import numpy as np
import pytest

from tests.test_polygons import RINGS, nested
from townlake.functions import arrangement
from townlake.operators import borders


def wavy(a, b, seed, n=40, high=0.004):
    """A line from a to b whose points wave; the same both ways round."""
    if b < a:
        return wavy(b, a, seed, n, high)[::-1]
    rng = random.Random(f"{a}{b}{seed}")
    d = (b[0] - a[0], b[1] - a[1])
    inner = [(k / n, high * math.sin(math.pi * k / n) * (rng.random() - 0.5)) for k in range(1, n)]
    return [a, *((a[0] + t * d[0] - o * d[1] / math.hypot(*d), a[1] + t * d[1] + o * d[0] / math.hypot(*d)) for t, o in inner), b]


def ring(corners, seed):
    out = []
    for a, b in zip(corners, [*corners[1:], corners[0]], strict=True):
        out += wavy(a, b, seed)[:-1]
    return [*out, out[0]]


def area(rings):
    return sum(arrangement._area2(np.array(r)[:-1]) for r in rings) / 2


@pytest.fixture(scope="module")
def coverage():
    """A grid of areas with waving borders, one with an island in a hole of it, and one far away."""
    shapes = {}
    for x in range(4):
        for y in range(3):
            c = lambda i, j: (round(0.1 * i, 6), round(0.1 * j, 6))
            shapes[10 * x + y] = [ring([c(x, y), c(x + 1, y), c(x + 1, y + 1), c(x, y + 1)], 1)]
    hole = ring([(0.13, 0.13), (0.17, 0.13), (0.17, 0.17), (0.13, 0.17)], 2)
    shapes[11].append(hole[::-1])
    shapes[100] = [hole]
    assert all(arrangement.is_valid([np.array(r) for r in rings]) for rings in shapes.values())
    shapes[101] = [ring([(3.0, 3.0), (3.1, 3.0), (3.0, 3.1)], 3)]
    return shapes


@pytest.mark.parametrize("tolerance", [0.0005, 0.003, 0.05])
def test_neighbours_have_no_gaps_or_overlaps(spark, coverage, tolerance):
    rows = spark.createDataFrame([(k, nested(r)) for k, r in coverage.items()] + [(500, None), (501, [])], f"area int, rings {RINGS}")
    got = {r.area: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in borders.simplified_together(rows, "area", tolerance).collect()}
    assert set(got) == set(coverage)
    before, after = (sum(len(r) for rings in s.values() for r in rings) for s in (coverage, got))
    assert after < (0.9 if tolerance < 0.001 else 0.5) * before
    for k, rings in got.items():
        assert len(rings) == len(coverage[k])
        assert arrangement.is_valid([np.array(r) for r in rings])
        assert all((area([r]) > 0) == (area([o]) > 0) for r, o in zip(rings, coverage[k], strict=True))
        assert all(set(r) <= set(o) for r, o in zip(rings, coverage[k], strict=True))
    whole = arrangement.arranged([[np.array(r) for r in rings] for rings in got.values()], arrangement.either)
    assert area(whole) == pytest.approx(sum(map(area, got.values())), abs=1e-9)  # nothing is covered twice
    assert len(whole) == 2  # no gap is left: the grid and what is far away


def test_no_point_goes_that_is_far_from_the_line_left(spark, coverage):
    tolerance = 0.001
    rows = spark.createDataFrame([(k, nested(r)) for k, r in coverage.items()], f"area int, rings {RINGS}")
    for r in borders.simplified_together(rows, "area", tolerance).collect():
        for new, old in zip(r.rings, coverage[r.area], strict=True):
            line = np.array([(p.x, p.y) for p in new])
            a, d = line[:-1], np.diff(line, axis=0)
            for p in np.array(old):
                t = np.clip(((p - a) * d).sum(1) / (d * d).sum(1), 0, 1)
                assert np.hypot(*(p - a - t[:, None] * d).T).min() <= tolerance + 1e-12


def test_an_arc_in_anothers_way_keeps_more_points(spark):
    """A deep bay with a spit in it: thinned alone, the bay's border would run through the spit."""
    bay = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.55, 1.0), (0.5, 0.2), (0.45, 1.0), (0.0, 1.0), (0.0, 0.0)]
    spit = [(0.49, 0.8), (0.5, 0.45), (0.51, 0.8), (0.5, 0.9), (0.49, 0.8)]
    rows = spark.createDataFrame([(1, nested([bay])), (2, nested([spit]))], f"area int, rings {RINGS}")
    got = {r.area: [np.array([(p.x, p.y) for p in ring]) for ring in r.rings] for r in borders.simplified_together(rows, "area", 0.9, 0.1).collect()}
    both = arrangement.arranged([got[1], got[2]], arrangement.both)
    assert both == [] and all(arrangement.is_valid(s) for s in got.values())
