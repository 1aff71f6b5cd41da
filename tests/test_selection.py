"""Exact percentiles against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from townlake.operators.selection import exact_percentiles

KINDS = {
    "even": lambda rng, i: rng.random() * 100,
    "wide": lambda rng, i: math.exp(rng.uniform(-300, 300)) * rng.choice((-1, 1)),
    "ties": lambda rng, i: float(rng.choice((1, 2, 2, 3))),
    "same": lambda rng, i: 7.25,
    "extreme": lambda rng, i: rng.choice((-1.7e308, 1.7e308, 0.0, 1e-320)),
    "one side": lambda rng, i: 0.0 if i % 3 else float(i),
    None: lambda rng, i: float(-i),
}


@pytest.mark.parametrize("at_once", [0, 40, 10**6])
@pytest.mark.parametrize("share", [0.5, 0.9])
def test_percentiles_equal_numpy(spark, at_once, share):
    rng = random.Random(4)
    rows = [(k, f(rng, i), i) for k, f in KINDS.items() for i in range({"even": 501, "same": 300}.get(k, 400))]
    rows += [("few", 1.0, 0), ("two", 1.0, 0), ("two", 2.0, 1), ("none", None, 0), ("odd", float("nan"), 0), ("odd", 4.0, 1)]
    table = spark.createDataFrame(rows, "kind string, v double, i int").repartition(5)
    got = {r.kind: (r.all, r.even) for r in exact_percentiles(table, ["kind"], {"all": F.col("v"), "even": F.when(F.col("i") % 2 == 0, F.col("v"))}, share, at_once).collect()}
    for kind in {k for k, *_ in rows}:
        for n, some in enumerate((lambda i: True, lambda i: i % 2 == 0)):
            values = [v for k, v, i in rows if k == kind and some(i) and v is not None and not math.isnan(v)]
            if not values:
                assert got[kind][n] is None
            elif kind != "extreme":  # numpy's own difference is infinite there
                assert got[kind][n] == pytest.approx(float(np.percentile(values, 100 * share)), rel=1e-9)
            else:
                assert got[kind][n] in values
    assert exact_percentiles(table.where("false"), ["kind"], {"all": F.col("v")}).collect() == []
