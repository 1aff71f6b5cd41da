"""Registers against each other, and indicators whose definitions are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townlake.operators.matching import Pass, match_ranked, nearest_of_key, numbers_of
from townlake.operators.tables import defined_values
from townlake.plans.tables import BUILDINGS_SQL, FACILITIES_SQL, buildings, facilities, metres_sql, table

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PARTS = ["", "A", "B"]


def _of(names: list[str], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (place % len(names) + 1).cast("int"))


def address_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as addresses: the customer at the same street and number, else block and number, else at a street by another name."""
    key, n = F.col("c_custkey"), (F.col("c_custkey") % 40 + 1).cast("string")
    text = F.when(key % 4 == 0, F.concat(n, F.lit("-"), (key % 40 + 5).cast("string"))).when(key % 4 == 1, F.concat(n, F.lit(", "), (key % 40 + 4).cast("string"))).otherwise(n)
    points = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("district"), F.col("c_mktsegment").alias("street"), (key % 7).alias("block"), F.explode(numbers_of(text)).alias("number"), _of(PARTS, key).alias("entrance")
    )
    own = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("district"), _of(SEGMENTS, own).alias("street"), (own % 7).alias("block"), (own % 45 + 1).cast("string").alias("number"),
        _of(PARTS, F.col("o_custkey")).alias("entrance"), F.array(_of(SEGMENTS, own + 1), _of(SEGMENTS, own + 3)).alias("other_names"), (own % 3).alias("kind"),
    )
    passes = [
        Pass("street", ("district", "street", "number"), left="kind <> 2"),
        Pass("block", ("district", "block", "number"), left="kind <> 1"),
        Pass("alternative_name", ("district", "number"), "other_names", "street", left="kind <> 2"),
    ]
    found = match_ranked(rows, points, "o_orderkey", "c_custkey", passes, "entrance")
    return found.select("o_orderkey", "c_custkey", "match", F.col("place").cast("long").alias("place"))


def nearest_of_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each building the facility whose key ends in the same digit: of the same nation's parity first, then the nearest."""
    homes = buildings(spark, sf_dir).select("c_custkey", (F.col("c_custkey") % 10).alias("digit"), (F.col("c_nationkey") % 2).alias("kind"), *[F.when(F.col("c_custkey") % 9 != 0, F.col(c)).alias(c) for c in ("lon", "lat")])
    places = facilities(spark, sf_dir).select("s_suppkey", (F.col("s_suppkey") % 10).alias("digit"), (F.col("s_nationkey") % 2).alias("kind"), "lon", "lat")
    found = nearest_of_key(homes, places, "c_custkey", "s_suppkey", "digit", "kind")
    return found.select("c_custkey", "s_suppkey", "agrees", F.round("distance_m").cast("long").alias("metres"))


#: indicator, field, factor, base.
DEFINITIONS = [
    ("customers", "customers", 1.0, None), ("balance", "balance", 1.0, None), ("suppliers", "suppliers", 1.0, None), ("debtors", "debtors", 1.0, None),
    ("balance_each", "balance", 1.0, "customers"), ("debtor_percent", "debtors", 100.0, "customers"), ("suppliers_each_100", "suppliers", 100.0, "customers"),
    ("customers_a_supplier", "customers", 1.0, "suppliers"), ("balance_thousands", "balance", 0.001, None), ("debtors_a_supplier", "debtors", 1.0, "suppliers"), ("of_nothing", "customers", 1.0, "gone"),
]


def defined_indicators(spark: SparkSession, sf_dir: str, definitions: DataFrame | None = None) -> DataFrame:
    """Indicators of nations by a table of definitions; no field is named by the plan."""
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count_if(F.col("c_acctbal") < 0).alias("debtors"))
    suppliers = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    both = customers.join(suppliers, F.col("c_nationkey") == F.col("s_nationkey"), "left").drop("s_nationkey")
    fields = F.from_json(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in both.columns if c != "c_nationkey"])), "map<string, string>")
    rows = both.select("c_nationkey", fields.alias("properties"))
    definitions = definitions or spark.createDataFrame(DEFINITIONS, "indicator string, field string, factor double, base string")
    found = defined_values(rows, definitions, "c_nationkey", "properties")
    return found.select("c_nationkey", "indicator", F.round("value", 3).alias("value"))


QUERIES = {f.__name__: f for f in (address_matches, nearest_of_number, defined_indicators)}

_LIST = ", ".join(f"'{s}'" for s in SEGMENTS)
_PARTS = ", ".join(f"'{p}'" for p in PARTS)

ORACLES = {
    "address_matches": f"""WITH c AS (
  SELECT c_custkey, c_nationkey AS district, c_mktsegment AS street, c_custkey % 7 AS block, c_custkey % 40 + 1 AS n, [{_PARTS}][c_custkey % 3 + 1] AS entrance FROM customer
), p AS (
  SELECT * EXCLUDE (n), unnest(CASE c_custkey % 4 WHEN 0 THEN [n, n + 2, n + 4] WHEN 1 THEN [n, n + 3] ELSE [n] END) AS number FROM c
), r AS (
  SELECT o_orderkey, o_custkey % 25 AS district, [{_LIST}][o_orderkey % 5 + 1] AS street, o_orderkey % 7 AS block, o_orderkey % 45 + 1 AS number, [{_PARTS}][o_custkey % 3 + 1] AS entrance,
         [[{_LIST}][(o_orderkey + 1) % 5 + 1], [{_LIST}][(o_orderkey + 3) % 5 + 1]] AS other_names, o_orderkey % 3 AS kind FROM orders
), m AS (
  SELECT o_orderkey, c_custkey, 'street' AS match, 1 AS pass, 0 AS place, p.entrance AS e, r.entrance AS f FROM r JOIN p USING (district, street, number) WHERE kind <> 2
  UNION ALL SELECT o_orderkey, c_custkey, 'block', 2, 0, p.entrance, r.entrance FROM r JOIN p USING (district, block, number) WHERE kind <> 1
  UNION ALL SELECT o_orderkey, c_custkey, 'alternative_name', 3, list_position(other_names, p.street), p.entrance, r.entrance
  FROM r JOIN p ON r.district = p.district AND r.number = p.number AND list_contains(other_names, p.street) WHERE kind <> 2
)
SELECT DISTINCT ON (o_orderkey) o_orderkey, c_custkey, match, CAST(place AS BIGINT) AS place FROM m
ORDER BY o_orderkey, pass, m.place, CASE WHEN e = f THEN 0 WHEN e = '' THEN 1 ELSE 2 END, c_custkey""",
    "nearest_of_number": f"""WITH {BUILDINGS_SQL}, {FACILITIES_SQL}, d AS (
  SELECT c_custkey, s_suppkey, c_nationkey % 2 = s_nationkey % 2 AS agrees, CASE WHEN c_custkey % 9 <> 0 THEN {metres_sql('b', 'f')} END AS m
  FROM buildings b JOIN facilities f ON c_custkey % 10 = s_suppkey % 10
)
SELECT DISTINCT ON (c_custkey) c_custkey, s_suppkey, agrees, CAST(round(m) AS BIGINT) AS metres FROM d ORDER BY c_custkey, agrees DESC, m NULLS LAST, s_suppkey""",
    "defined_indicators": """WITH f AS (
  SELECT c_nationkey, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, count(*) FILTER (c_acctbal < 0) AS debtors, (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) AS n FROM customer GROUP BY 1
), g AS (SELECT *, CASE WHEN n > 0 THEN n END AS suppliers FROM f), v AS (
  SELECT c_nationkey, unnest(['customers', 'balance', 'suppliers', 'debtors', 'balance_each', 'debtor_percent', 'suppliers_each_100', 'customers_a_supplier', 'balance_thousands', 'debtors_a_supplier']) AS indicator,
         unnest([customers, balance, suppliers, debtors, balance / customers, debtors * 100e0 / customers, suppliers * 100e0 / customers, customers / CAST(suppliers AS DOUBLE), balance * 0.001e0, debtors / CAST(suppliers AS DOUBLE)]) AS value FROM g
)
SELECT c_nationkey, indicator, round(value, 3) AS value FROM v WHERE value IS NOT NULL""",
}
