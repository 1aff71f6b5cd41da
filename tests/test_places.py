"""Rows that share a place are measured once, however many there are."""

import random

import pytest
from pyspark.sql import functions as F

from townlake.operators import reach, spatial
from townlake.operators.matching import nearest_of_key
from townlake.operators.polygons import once_per_shape, with_proper_rings
from townlake.operators.tables import set_counts
from townlake.plans import access, area_views, shapes


@pytest.fixture
def measured(monkeypatch):
    """How many pairs each radius join made."""
    pairs, join = [], spatial.radius_join

    def counting(*args, **more):
        found = join(*args, **more)
        pairs.append(found.count())
        return found

    for module in (spatial, reach, access, shapes, area_views):
        monkeypatch.setattr(module, "radius_join", counting)
    return pairs


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Ten places with thirty buildings and thirty facilities each: keys that are 10007 apart share a place."""
    folder = str(tmp_path_factory.mktemp("crowded"))
    keys = spark.range(10).crossJoin(spark.range(30).toDF("k")).select((F.col("id") + F.col("k") * 10007).alias("key"))
    nation = spark.range(25).select(F.col("id").alias("n_nationkey"), (F.col("id") % 5).alias("n_regionkey"))
    nation.write.parquet(f"{folder}/nation.parquet")
    keys.select(F.col("key").alias("c_custkey"), (F.col("key") % 25).alias("c_nationkey"), (F.col("key") % 9000).cast("double").alias("c_acctbal"), F.lit("A").alias("c_mktsegment")).write.parquet(f"{folder}/customer.parquet")
    keys.select((F.col("key") + 9507).alias("s_suppkey"), (F.col("key") % 25).alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")).write.parquet(f"{folder}/supplier.parquet")
    return folder


def test_reach_measures_places_once(spark, crowded, measured):
    got = access.facilities_in_reach(spark, crowded).collect()
    assert len(got) == 300 and all(r.facilities % 30 == 0 and r.nearest_m == 0 for r in got)
    caught = access.facility_catchment(spark, crowded).collect()
    assert len(caught) == 300 and all(r.n_1000 % 30 == 0 for r in caught)
    preferred = access.preferred_facility(spark, crowded).collect()
    assert len(preferred) == 300 and all(r.existing for r in preferred)
    assert len(shapes.reach_agreement(spark, crowded).collect()) == 26 and len(shapes.assigned_facility(spark, crowded).collect()) == 5
    assert area_views.agreement_classes(spark, crowded).count() == 25
    assert measured and max(measured) <= 200


def test_nearest_measures_places_once(spark, measured):
    rng = random.Random(5)
    spots = [(23 + rng.random() / 5, 42 + rng.random() / 5) for _ in range(12)]
    left = spark.createDataFrame([(i, i % 2, *spots[i % 12]) for i in range(600)], "l long, k long, lon double, lat double")
    right = spark.createDataFrame([(i, i % 3, *spots[i % 7]) for i in range(600)], "r long, k long, lon double, lat double")
    got = {r.l: r.r for r in spatial.nearest(left, right, "l", "r").collect()}
    three = spatial.nearest_k(left, right, "l", "r", 3, on=["k"]).collect()
    assert max(measured) <= 12 * 2 * 7 * 3 * 3
    assert all(got[i] == i % 12 for i in range(600) if i % 12 < 7)
    assert sorted(r.r for r in three if r.l == 0) == [0, 21, 42] and {r.distance_m for r in three if r.l == 0} == {0.0}
    assert len(three) == 1800


def test_nearest_of_a_key_with_many_rows(spark, measured):
    left = spark.createDataFrame([(i, i % 2, "a", 23 + i % 50 / 100, 42.5) for i in range(500)], "l long, k long, kind string, lon double, lat double")
    right = spark.createDataFrame([(i, i % 2, "ab"[i % 4 // 2], 23 + i % 40 / 100, 42.5) for i in range(400)], "r long, k long, kind string, lon double, lat double")
    got = {r.l: (r.r, r.agrees) for r in nearest_of_key(left, right, "l", "r", "k", "kind").collect()}
    assert len(got) == 500 and all(agrees for _, agrees in got.values()) and got[0] == (0, True) and got[45] == (37, True)
    assert measured  # by cells, not by all pairs of a key


def test_events_in_reach_of_places(spark, measured):
    homes = spark.createDataFrame([(i, 23 + i % 3 / 1000, 42.5) for i in range(90)], "h long, lon double, lat double")
    stops = spark.createDataFrame([(i, 23 + i % 4 / 1000, 42.5) for i in range(80)], "s long, lon double, lat double")
    calls = spark.createDataFrame([(i % 80, i % 7) for i in range(300)], "s long, e long")
    counts, reached = reach.events_in_reach(homes, stops, calls, "h", "s", "e", 150.0)
    assert max(measured) <= 12
    places = {h: [s for s in range(4) if abs(h % 3 - s) <= 1] for h in range(90)}
    assert {r.h: r.stops for r in reached.collect()} == {h: 20 * len(near) for h, near in places.items()}
    assert {r.h: r.events for r in counts.collect()} == {h: len({i % 7 for i in range(300) if i % 80 % 4 in near}) for h, near in places.items()}


def test_counts_of_large_sets_and_of_events_at_many_places(spark):
    rng = random.Random(8)
    near = {(m, p) for m in range(30) for p in rng.sample(range(60), rng.choice((1, 14, 40)))}
    calls = [(p, e) for e in range(300) for p in rng.sample(range(60), 30 if e < 5 else rng.randint(1, 6))]
    got = set_counts(spark.createDataFrame(sorted(near), "m int, p int"), spark.createDataFrame(calls, "p int, e int"), "m", "p", "e")
    want = {m: len({e for p, e in calls if (m, p) in near}) for m in range(30)}
    assert {r.m: r.events for r in got.collect()} == want


def test_equal_shapes_are_mended_once(spark):
    bow_tie = [[{"x": float(x), "y": float(y)} for x, y in ((0, 0), (1, 1), (1, 0), (0, 1), (0, 0))]]
    rows = spark.createDataFrame([(i, bow_tie if i % 2 else None) for i in range(400)], "i long, rings array<array<struct<x: double, y: double>>>")
    looked_at = []

    def counting(shapes):
        looked_at.append(shapes.count())
        return shapes.withColumn("n", F.size("shape"))

    assert once_per_shape(rows, counting).count() == 400 and looked_at == [2]
    mended = with_proper_rings(rows).collect()
    assert len(mended) == 400 and not any(r.was_valid for r in mended) and {len(r.rings) for r in mended if r.i % 2} == {2}


def test_metres_to_area_is_dealt_out(spark, crowded):
    plan = shapes.metres_to_area(spark, crowded)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "Aggregate [c_nationkey" in plan
