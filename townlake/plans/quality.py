"""Data-quality rules in one form: those on the same rows share one pass, the others are queries of their own."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townlake.plans.tables import table

RULES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rule(find: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a rule; its rows are (entity, detail), its name is the issue."""
    RULES[find.__name__] = find
    return find


def _found(rows: DataFrame, entity: Column, *detail: Column | str) -> DataFrame:
    parts = [F.lit(d) if isinstance(d, str) else F.coalesce(d.cast("string"), F.lit("")) for d in detail]
    return rows.select(entity.cast("string").alias("entity"), F.concat(*parts).alias("detail"))


@rule
def customer_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return _found(customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").where("c_acctbal < 0"), F.col("c_custkey"), "no orders, balance below zero")


@rule
def name_used_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")
    return _found(twice, F.col("first"), F.col("n"), " parts are named ", F.col("p_name"))


@rule
def order_of_unknown_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return _found(orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), F.col("o_orderkey"), "customer ", F.col("o_custkey"), " is not known")


@rule
def nation_without_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return _found(nation.join(supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left_anti"), F.col("n_name"), "no supplier")


@rule
def type_spelled_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.regexp_replace(F.lower("p_type"), r"[^\p{L}\p{N}]+", "")
    spelled = table(spark, sf_dir, "part").groupBy(key.alias("key")).agg(F.countDistinct("p_type").alias("n"))
    return _found(spelled.where("n > 1"), F.col("key"), F.col("n"), " spellings")


@rule
def value_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = table(spark, sf_dir, "events").where("value < 0 or value > 250").groupBy("event_type").agg(F.count("*").alias("n"))
    return _found(odd, F.col("event_type"), F.col("n"), " values below 0 or above 250")


def _together(facts: DataFrame, checks: dict[str, tuple[Column, Column, list[Column | str]]]) -> DataFrame:
    """(issue, entity, detail) of rules on the same rows: each is a condition, an entity and the parts of a detail."""
    issues = []
    for name, (condition, entity, detail) in checks.items():
        parts = [F.lit(d) if isinstance(d, str) else F.coalesce(d.cast("string"), F.lit("")) for d in detail]
        issues.append(F.when(condition, F.struct(F.lit(name).alias("issue"), entity.cast("string").alias("entity"), F.concat(*parts).alias("detail"))))
    return facts.select(F.inline(F.filter(F.array(*issues), lambda i: i.isNotNull())))


def order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rules on an order and its items, of one pass over both."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    met = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    facts = met.groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.max("l_linenumber").alias("last"), F.max("l_extendedprice").alias("dearest"), F.min("l_linestatus").alias("low"), F.max("l_linestatus").alias("high"),
        F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("early"), F.max("o_totalprice").alias("price"), F.max("o_orderstatus").alias("status"),
    )
    c, key = F.col, F.col("l_orderkey")
    whole = (c("low") == c("high")) & (c("low") != c("status")) & c("status").isin("F", "O")
    return _together(facts, {
        "shipped_before_ordered": (c("early") > 0, key, [c("early"), " items shipped before the order"]),
        "price_far_from_sum": (c("dearest") > c("price"), key, ["an item costs more than the order"]),
        "items_missing": (c("n") != c("last"), key, [c("n"), " items, numbered up to ", c("last")]),
        "status_against_items": (whole, key, ["order ", c("status"), ", items ", c("low")]),
    })


def item_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules on the items of a part, of one pass."""
    unit = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    items = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min(unit).alias("low"), F.max(unit).alias("high"))
    facts = items.join(table(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left")
    c, key = F.col, F.col("l_partkey")
    return _together(facts, {
        "item_of_unknown_part": (c("p_partkey").isNull(), key, [c("n"), " items of a part that is not known"]),
        "price_per_unit_differs": (c("high") > 1.5 * c("low"), key, ["dearest over half as much again as the cheapest"]),
    })


def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues found, as (issue, entity, detail)."""
    alone = [find(spark, sf_dir).select(F.lit(name).alias("issue"), "entity", "detail") for name, find in RULES.items()]
    return reduce(DataFrame.unionByName, [*alone, order_issues(spark, sf_dir), item_issues(spark, sf_dir)])


QUERIES = {"quality_issues": quality_issues}

ORACLES = {
    "quality_issues": """SELECT 'customer_without_orders' AS issue, CAST(c_custkey AS VARCHAR) AS entity, 'no orders, balance below zero' AS detail
FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'shipped_before_ordered', CAST(o_orderkey AS VARCHAR), count(*) || ' items shipped before the order'
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate GROUP BY o_orderkey
UNION ALL SELECT 'name_used_twice', CAST(min(p_partkey) AS VARCHAR), count(*) || ' parts are named ' || p_name FROM part GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'price_far_from_sum', CAST(o_orderkey AS VARCHAR), 'an item costs more than the order'
FROM orders JOIN (SELECT l_orderkey, max(l_extendedprice) AS d FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE d > o_totalprice
UNION ALL SELECT 'order_of_unknown_customer', CAST(o_orderkey AS VARCHAR), 'customer ' || o_custkey || ' is not known' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'item_of_unknown_part', CAST(l_partkey AS VARCHAR), count(*) || ' items of a part that is not known' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY l_partkey
UNION ALL SELECT 'nation_without_supplier', n_name, 'no supplier' FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'items_missing', CAST(l_orderkey AS VARCHAR), count(*) || ' items, numbered up to ' || max(l_linenumber) FROM lineitem GROUP BY l_orderkey HAVING count(*) <> max(l_linenumber)
UNION ALL SELECT 'status_against_items', CAST(o_orderkey AS VARCHAR), 'order ' || o_orderstatus || ', items ' || a FROM orders
  JOIN (SELECT l_orderkey, min(l_linestatus) AS a, max(l_linestatus) AS b FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE a = b AND a <> o_orderstatus AND o_orderstatus IN ('F', 'O')
UNION ALL SELECT 'price_per_unit_differs', CAST(l_partkey AS VARCHAR), 'dearest over half as much again as the cheapest' FROM lineitem GROUP BY l_partkey
  HAVING max(round(l_extendedprice / l_quantity, 2)) > 1.5e0 * min(round(l_extendedprice / l_quantity, 2))
UNION ALL SELECT 'type_spelled_twice', k, n || ' spellings' FROM (SELECT regexp_replace(lower(p_type), '[^\\p{L}\\p{N}]+', '', 'g') AS k, count(DISTINCT p_type) AS n FROM part GROUP BY 1) WHERE n > 1
UNION ALL SELECT 'value_out_of_range', event_type, count(*) || ' values below 0 or above 250' FROM events WHERE value < 0 OR value > 250 GROUP BY event_type""",
}
