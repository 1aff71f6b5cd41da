"""Ranked matching, nearest rows of a key and defined indicators against plain Python."""

import random
from itertools import product

from pyspark.sql import functions as F

from townlake.functions.geo import distance_m
from townlake.operators.matching import Pass, match_ranked, nearest_of_key, numbers_of
from townlake.operators.tables import defined_values
from townlake.plans import registers


def test_ranked_matches_equal_plain_python(spark):
    rng = random.Random(6)
    names, parts = ["n1", "n2", "n3", None], ["", "A", "B", None]
    right = [(i, rng.choice("xy"), rng.choice(names), rng.choice(names), rng.choice("123"), rng.choice(parts)) for i in range(120)]
    left = [(i, rng.choice("xy"), rng.choice(names), rng.choice("123"), rng.choice(parts), rng.sample(["n1", "n2", "n3"], rng.randint(0, 3)), rng.choice(["area", "street", None])) for i in range(150)]
    passes = [Pass("street", ("d", "name", "num"), left="not kind <=> 'area'"), Pass("alt", ("d", "num"), "alts", "name", left="not kind <=> 'area'"), Pass("block", ("d", "block", "num"), left="not kind <=> 'street'")]
    l = spark.createDataFrame(left, "l int, d string, name string, num string, part string, alts array<string>, kind string").withColumn("block", F.col("name"))
    r = spark.createDataFrame(right, "r int, d string, name string, block string, num string, part string")
    want = {}
    for (i, d, name, num, part, alts, kind), (j, d2, name2, block2, num2, part2) in product(left, right):
        if d != d2 or num != num2:
            continue
        order = []
        if kind != "area" and name and name == name2:
            order.append((0, 0, "street"))
        if kind != "area" and name2 in alts and name2:
            order.append((1, alts.index(name2) + 1, "alt"))
        if kind != "street" and name and name == block2:
            order.append((2, 0, "block"))
        choice = 0 if (part or "") == (part2 or "") else 1 if not part2 else 2
        for p, alt, text in order:
            rank = (p, alt, choice, j, text)
            want[i] = min(want.get(i, rank), rank)
    got = {x.l: (x.r, x.match, x.place) for x in match_ranked(l, r, "l", "r", passes, "part").collect()}
    assert got == {i: (w[3], w[4], w[1]) for i, w in want.items()}
    assert {w[4] for w in want.values()} == {"street", "alt", "block"}


def test_number_lists(spark):
    texts = ["12", "12-16", "11-16", "12–18", "16-12", "1-999", "3, 5a;7-9", "", None, "a-b", " 4 - 8 ,4"]
    want = [["12"], ["12", "14", "16"], ["11", "12", "13", "14", "15", "16"], ["12", "14", "16", "18"], ["16-12"], ["1-999"], ["3", "5a", "7", "9"], [], None, ["a-b"], ["4", "6", "8"]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", numbers_of(F.col("t")).alias("n")).collect()
    assert [r.n for r in sorted(rows)] == want


def test_nearest_of_key_equals_plain_python(spark):
    rng = random.Random(9)
    place = lambda: (None, None) if rng.random() < 0.2 else (23 + rng.random(), 42 + rng.random())
    left = [(i, rng.choice([1, 2, 3, 9, None]), rng.choice("ab"), *place()) for i in range(120)]
    right = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "a", "b", None]), *place()) for i in range(90)]
    l, r = spark.createDataFrame(left, "l int, k int, kind string, lon double, lat double"), spark.createDataFrame(right, "r int, k int, kind string, lon double, lat double")
    pairs = l.join(r.toDF("r", "k2", "kind2", "lon2", "lat2"), F.col("k") == F.col("k2")).withColumn("m", distance_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))).collect()
    want = {}
    for p in pairs:
        rank = (p.kind != p.kind2, p.m is None, p.m or 0.0, p.r)
        want[p.l] = min(want.get(p.l, rank), rank)
    for most in (10_000, 10):
        got = {x.l: (x.r, x.agrees) for x in nearest_of_key(l, r, "l", "r", "k", "kind", most).collect()}
        assert got == {i: (w[3], not w[0]) for i, w in want.items()}


def test_a_new_indicator_needs_no_code(spark):
    sf = "/root/testdata/sf0.001"
    more = spark.createDataFrame([*registers.DEFINITIONS, ("debtors_twice", "debtors", 2.0, None)], "indicator string, field string, factor double, base string")
    rows = {(r.c_nationkey, r.indicator): r.value for r in registers.defined_indicators(spark, sf, more).collect()}
    old = {(r.c_nationkey, r.indicator): r.value for r in registers.defined_indicators(spark, sf).collect()}
    assert {k: v for k, v in rows.items() if k[1] != "debtors_twice"} == old
    assert all(rows[n, "debtors_twice"] == 2 * v for (n, i), v in old.items() if i == "debtors") and len(rows) > len(old)


def test_fields_that_are_no_number(spark):
    rows = spark.createDataFrame([(1, {"a": "3", "b": "x", "c": "0", "d": None}), (2, {}), (3, None)], "k int, p map<string, string>")
    definitions = [("i1", "a", 2.0, None), ("i2", "b", 1.0, None), ("i3", "a", 1.0, "c"), ("i4", "a", 1.0, "b"), ("i5", "d", 1.0, None), ("i6", "a", 1.0, "a"), ("i7", "zz", 1.0, None)]
    got = defined_values(rows, spark.createDataFrame(definitions, "indicator string, field string, factor double, base string"), "k", "p").collect()
    assert sorted((r.k, r.indicator, r.value) for r in got) == [(1, "i1", 6.0), (1, "i6", 1.0)]
