"""Queries over whole tables against plain Python."""

from collections import defaultdict

from townlake.plans import CITY_QUERIES

SF = "/root/testdata/sf0.001"


def test_every_order_is_matched(spark):
    customers = [r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()]
    want = {}
    for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        fits = [c for c in customers if c % 10 == r.o_orderkey % 10 and str(c).startswith(str(r.o_custkey)[:3])]
        if len(fits) == 1:
            want[r.o_orderkey] = fits[0]
    got = {r.o_orderkey: r.c_custkey for r in CITY_QUERIES["unique_blocks_all"](spark, SF).collect()}
    assert got == want and any(k % 50 for k in got)


def test_every_building_is_measured(spark):
    got = [r.c_custkey for r in CITY_QUERIES["metres_to_area_all"](spark, SF).collect()]
    assert sorted(got) == sorted(r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").collect())


def test_every_event_is_stored_or_incoming(spark):
    sides = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/events.parquet").collect():
        sides[r.event_id % 2].add((r.user_id, r.ts.replace(second=0, microsecond=0)))
    days = defaultdict(int)
    for _, minute in sides[1] - sides[0]:
        days[minute.strftime("%Y%m%d")] += 1
    assert {r.day: r.n for r in CITY_QUERIES["stored_reports_all"](spark, SF).collect()} == days
