"""Views by area: transit shares of residents, agreement with another source, residents' distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townlake.functions.geo import distance_m
from townlake.functions.values import rounded_metres, share
from townlake.operators.reach import events_in_reach
from townlake.operators.rollup import area_rollup
from townlake.operators.selection import exact_percentiles
from townlake.operators.spatial import areas_of_points, box_rings, radius_join
from townlake.plans.tables import BOXES_SQL, BUILDINGS_SQL, FACILITIES_SQL, boxes, buildings, facilities, metres_sql, table

#: Windows of transit: name, kind of day, first and last hour (that one excluded). Fixed values.
WINDOWS = (("peak", "weekday", 7, 9), ("evening", "weekday", 20, 23), ("saturday", "saturday", 10, 18), ("sunday", "sunday", 10, 18), ("night", "weekday", 1, 4))
#: Metres to a stop, and trips an hour that are frequent, and that are any at night (fixed values).
REACH_M, FREQUENT, AT_NIGHT = 400.0, 12, 1
#: Metres within which two sources should agree, and from which on they contradict each other.
NEAR_M, FAR_M = 1500.0, 2000.0


def _residents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings with residents, and whether another source says that they are served."""
    served = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") > 3000)
    return buildings(spark, sf_dir).select("c_custkey", "n_regionkey", "c_nationkey", "lon", "lat", (F.col("c_custkey") % 50 + 1).alias("people"), served.alias("served"))


def _levels() -> dict[str, Column]:
    return {"city": F.lit("all"), "region": F.col("n_regionkey"), "nation": F.col("c_nationkey")}


def _day() -> Column:
    return F.when(F.dayofweek("l_shipdate") == 7, "saturday").when(F.dayofweek("l_shipdate") == 1, "sunday").otherwise("weekday")


def _window_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor((F.col("l_orderkey") * 97 + F.col("l_linenumber") * 1300) % 86400 / 3600)
    window = F.coalesce(*[F.when((_day() == day) & (hour >= a) & (hour < b), name) for name, day, a, b in WINDOWS])
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stop_id"), F.col("l_orderkey").alias("trip"), window.alias("window"))
    return calls.where("window is not null")


def area_transit_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of residents with a stop in reach and with frequent trips in five windows, against another source, and the median peak."""
    homes = _residents(spark, sf_dir)
    stops = facilities(spark, sf_dir).select(F.col("s_suppkey").alias("stop_id"), "lon", "lat")
    near = rounded_metres(F.col("distance_m")) <= REACH_M
    counted, reached = events_in_reach(homes, stops, _window_trips(spark, sf_dir), "c_custkey", "stop_id", "trip", REACH_M + 1, ["window"], near)
    rate = lambda name, hours: F.max(F.when(F.col("window") == name, F.round(F.col("events") / hours, 1))).alias(name)
    rates = counted.groupBy("c_custkey").agg(*[rate(name, b - a) for name, _, a, b in WINDOWS])
    facts = homes.join(reached, "c_custkey", "left").join(rates, "c_custkey", "left")
    facts = facts.withColumns({"stops": F.coalesce("stops", F.lit(0)), **{name: F.coalesce(name, F.lit(0.0)) for name, *_ in WINDOWS}})
    people = F.sum("people")
    part = lambda condition: share(F.sum(F.when(condition, F.col("people"))), people)
    has, served = F.col("stops") > 0, F.col("served")
    shares = area_rollup(facts, _levels(), {
        "people": people, "transit_share": part(has), "frequent_share": part(F.col("peak") >= FREQUENT), "evening_share": part(F.col("evening") >= FREQUENT),
        "saturday_share": part(F.col("saturday") >= FREQUENT), "sunday_share": part(F.col("sunday") >= FREQUENT), "night_share": part(F.col("night") >= AT_NIGHT),
        "other_share": part(served), "ours_only_share": part(has & ~served), "theirs_only_share": part(~has & served),
    })
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("area_kind"), key.cast("string").alias("area_id")) for kind, key in _levels().items()]))
    medians = exact_percentiles(facts.select(each.alias("a"), "peak").select("a.*", "peak"), ["area_kind", "area_id"], {"median_peak": F.col("peak")})
    return shares.join(medians, ["area_kind", "area_id"]).withColumn("median_peak", F.round("median_peak", 1))


def agreement_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How another source's judgement agrees with the nearest facility that exists, in six classes by area, with shares of residents."""
    homes = _residents(spark, sf_dir).where("served is not null")
    places = facilities(spark, sf_dir).groupBy("lon", "lat").agg(F.bool_or(F.col("s_suppkey") % 2 == 0).alias("exists"))
    pairs = radius_join(homes.select("lon", "lat").distinct(), places, FAR_M)
    found = pairs.groupBy("lon", "lat").agg(F.min(F.when(F.col("exists"), F.col("distance_m"))).alias("m"), F.min("distance_m").alias("any_m"))
    facts = homes.join(found, ["lon", "lat"], "left")
    ours = F.coalesce(F.col("m") <= NEAR_M, F.lit(False))
    kind = (
        F.when(F.col("served") & ours, "both").when(~F.col("served") & ~ours, "neither").when(~F.col("served"), "ours_only")
        .when(F.col("any_m") <= NEAR_M, "excluded_place").when(F.col("any_m") <= FAR_M, "beyond_near").otherwise("beyond_far")
    )
    facts, people = facts.withColumns({"agreement": kind, "ours": ours}), F.sum("people")
    classes = ["both", "neither", "ours_only", "excluded_place", "beyond_near", "beyond_far"]
    return area_rollup(facts, _levels(), {
        "buildings": F.count("*"), **{name: F.count_if(F.col("agreement") == name) for name in classes},
        "their_share": share(F.sum(F.when(F.col("served"), F.col("people"))), people), "our_share": share(F.sum(F.when(F.col("ours"), F.col("people"))), people),
    })


def resident_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each area the residents in it, and their mean and largest distance from its middle; areas without residents have 0."""
    homes = _residents(spark, sf_dir)
    areas = boxes(spark, sf_dir)
    inside = areas_of_points(homes, areas.select("area", box_rings(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("rings")), "c_custkey", "area")
    middle = areas.select("area", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    placed = homes.join(inside, "c_custkey").join(middle, "area").withColumn("m", distance_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")))
    sums = placed.groupBy("area").agg(F.sum("people").alias("residents"), F.round(F.sum(F.col("people") * F.col("m")) / F.sum("people")).cast("long").alias("mean_m"), F.round(F.max("m")).cast("long").alias("max_m"))
    return areas.select("area").join(sums, "area", "left").withColumn("residents", F.coalesce("residents", F.lit(0)))


QUERIES = {f.__name__: f for f in (area_transit_shares, agreement_classes, resident_distances)}

_RESIDENTS = f"""{BUILDINGS_SQL}, {FACILITIES_SQL}, r AS (SELECT *, c_custkey % 50 + 1 AS people, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal > 3000 END AS served FROM buildings),
pairs AS (SELECT b.c_custkey, f.s_suppkey, {metres_sql('b', 'f')} AS d FROM buildings b, facilities f)"""
_AREAS = "(SELECT *, unnest([{'k': 'city', 'i': 'all'}, {'k': 'region', 'i': CAST(n_regionkey AS VARCHAR)}, {'k': 'nation', 'i': CAST(c_nationkey AS VARCHAR)}]) AS a FROM %s)"


def _part(condition: str) -> str:
    return f"round(coalesce(sum(people) FILTER ({condition}), 0) / CAST(sum(people) AS DOUBLE), 3)"


def _rate(name: str, day: str, a: int, b: int) -> str:
    return f"round(count(DISTINCT l_orderkey) FILTER (day = '{day}' AND h >= {a} AND h < {b}) / {b - a}e0, 1) AS {name}"


ORACLES = {
    "area_transit_shares": f"""WITH {_RESIDENTS}, near AS (SELECT c_custkey, s_suppkey FROM pairs WHERE round(d) <= {REACH_M}),
calls AS (SELECT DISTINCT l_suppkey, l_orderkey, CASE dayofweek(l_shipdate) WHEN 6 THEN 'saturday' WHEN 0 THEN 'sunday' ELSE 'weekday' END AS day,
          (l_orderkey * 97 + l_linenumber * 1300) % 86400 // 3600 AS h FROM lineitem),
rates AS (SELECT c_custkey, {', '.join(_rate(*w) for w in WINDOWS)} FROM near JOIN calls ON l_suppkey = s_suppkey GROUP BY 1),
stops AS (SELECT c_custkey, count(*) AS stops FROM near GROUP BY 1),
f AS (SELECT r.*, coalesce(stops, 0) AS stops, {', '.join(f'coalesce({n}, 0) AS {n}' for n, *_ in WINDOWS)} FROM r LEFT JOIN stops USING (c_custkey) LEFT JOIN rates USING (c_custkey))
SELECT a.k AS area_kind, a.i AS area_id, CAST(sum(people) AS BIGINT) AS people, {_part('stops > 0')} AS transit_share, {_part(f'peak >= {FREQUENT}')} AS frequent_share, {_part(f'evening >= {FREQUENT}')} AS evening_share,
       {_part(f'saturday >= {FREQUENT}')} AS saturday_share, {_part(f'sunday >= {FREQUENT}')} AS sunday_share, {_part(f'night >= {AT_NIGHT}')} AS night_share, {_part('served')} AS other_share,
       {_part('stops > 0 AND NOT served')} AS ours_only_share, {_part('stops = 0 AND served')} AS theirs_only_share, round(median(peak), 1) AS median_peak
FROM {_AREAS % 'f'} GROUP BY 1, 2""",
    "agreement_classes": f"""WITH {_RESIDENTS}, m AS (SELECT c_custkey, min(d) FILTER (s_suppkey % 2 = 0 AND d <= {FAR_M}) AS m, min(d) FILTER (d <= {FAR_M}) AS any_m FROM pairs GROUP BY 1),
f AS (SELECT *, coalesce(m <= {NEAR_M}, false) AS ours FROM r JOIN m USING (c_custkey) WHERE served IS NOT NULL),
c AS (SELECT *, CASE WHEN served AND ours THEN 'both' WHEN NOT served AND NOT ours THEN 'neither' WHEN NOT served THEN 'ours_only' WHEN any_m <= {NEAR_M} THEN 'excluded_place'
      WHEN any_m <= {FAR_M} THEN 'beyond_near' ELSE 'beyond_far' END AS k FROM f)
SELECT a.k AS area_kind, a.i AS area_id, count(*) AS buildings, {', '.join(f"count(*) FILTER (g.k = '{n}') AS {n}" for n in ('both', 'neither', 'ours_only', 'excluded_place', 'beyond_near', 'beyond_far'))},
       {_part('served')} AS their_share, {_part('ours')} AS our_share FROM {_AREAS % 'c'} g GROUP BY 1, 2""",
    "resident_distances": f"""WITH {_RESIDENTS}, {BOXES_SQL}, i AS (SELECT c_custkey, min(area) AS area FROM r JOIN boxes ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY 1),
p AS (SELECT b.area, people, {metres_sql('r', 'c')} AS m FROM r JOIN i USING (c_custkey) JOIN boxes b ON b.area = i.area JOIN (SELECT area, (x0 + x1) / 2 AS lon, (y0 + y1) / 2 AS lat FROM boxes) c ON c.area = b.area),
s AS (SELECT area, CAST(sum(people) AS BIGINT) AS residents, CAST(round(sum(people * m) / sum(people)) AS BIGINT) AS mean_m, CAST(round(max(m)) AS BIGINT) AS max_m FROM p GROUP BY 1)
SELECT area, coalesce(residents, 0) AS residents, mean_m, max_m FROM boxes LEFT JOIN s USING (area)""",
}
