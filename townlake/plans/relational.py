"""Shares, medians, latest rows, lists and indicators over orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townlake.functions.values import share
from townlake.operators.rollup import area_rollup
from townlake.operators.selection import exact_percentiles
from townlake.operators.tables import (
    first_per_key,
    long_form,
    needs_load,
    set_counts,
    snapshot_changes,
    upsert,
)
from townlake.plans.tables import table


def order_status_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and shares of open and urgent ones by segment; a whole of zero has no share."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy("c_mktsegment").agg(
        F.count("*").alias("orders"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        share(F.count_if(F.col("o_orderstatus") == "O"), F.count("*")).alias("open_share"),
        share(
            F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")), F.count_if(F.col("o_orderstatus") == "O")
        ).alias("urgent_share"),
    )


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the larger balance that never ordered, and those that ordered urgently."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    none = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").where("c_acctbal > 0").withColumn("kind", F.lit("none"))
    urgent = orders.where("o_orderpriority = '1-URGENT'")
    some = customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").withColumn("kind", F.lit("urgent"))
    return none.unionByName(some).select("c_custkey", "kind")


def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each customer, the larger key on ties."""
    newest = first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return newest.select("o_custkey", "o_orderkey", "o_totalprice")


def price_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of all and of open orders, at two levels."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    levels = {"city": F.lit("all"), "segment": F.col("c_mktsegment")}
    counts = area_rollup(orders, levels, {"orders": F.count("*")})
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("area_kind"), key.alias("area_id")) for kind, key in levels.items()]))
    facts = orders.select(each.alias("level"), "o_totalprice", "o_orderstatus").select("level.*", "o_totalprice", "o_orderstatus")
    price = F.col("o_totalprice")
    medians = exact_percentiles(facts, ["area_kind", "area_id"], {"price": price, "open": F.when(F.col("o_orderstatus") == "O", price)})
    return counts.join(medians, ["area_kind", "area_id"]).select("area_kind", "area_id", "orders", F.round("price", 2).alias("median_price"), F.round("open", 2).alias("median_open"))


def commonest_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent priority of each nation's orders, the first by name on ties."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = orders.groupBy("c_nationkey", "o_orderpriority").agg(F.count("*").alias("n"))
    best = first_per_key(counts, ["c_nationkey"], [F.col("n").desc(), F.col("o_orderpriority")])
    return best.select("c_nationkey", F.col("o_orderpriority").alias("priority"), "n")


def quantity_price_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.count("*").alias("n"))


def nation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered and distinct lists of a region's nations as text and as JSON."""
    nation = table(spark, sf_dir, "nation")
    names = F.array_sort(F.collect_list("n_name"))
    return nation.groupBy("n_regionkey").agg(
        F.array_join(names, ", ").alias("names"),
        F.element_at(names, 1).alias("first_name"),
        F.to_json(F.array_sort(F.collect_list("n_nationkey"))).alias("keys_json"),
        F.array_join(F.array_sort(F.collect_set(F.substring("n_name", 1, 1))), "").alias("initials"),
    )


def large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with more than 1.1 times the mean number of parts, and with small ones among them."""
    part = table(spark, sf_dir, "part")
    counts = part.groupBy("p_brand").agg(F.count("*").alias("parts"), F.count_if(F.col("p_size") < 10).alias("small"))
    mean = counts.agg(F.avg("parts").alias("mean"))
    return counts.crossJoin(F.broadcast(mean)).where((F.col("parts") > 1.1 * F.col("mean")) & (F.col("small") > 0)).drop("mean")


def two_level_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers counted by nation, united and summed by region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return a.unionByName(b).join(F.broadcast(nation), "n_nationkey").groupBy("n_regionkey").agg(F.sum("n").alias("n"), F.max("n").alias("most"))


def orders_per_supplier_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct orders that touch any of the suppliers that a brand's parts are bought from."""
    calls = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return set_counts(calls, calls, "p_brand", "l_suppkey", "l_orderkey")


def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's part of all events, and its running number by size."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    return counts.select(
        "event_type", "n", F.round(F.col("n") / F.sum("n").over(whole), 4).alias("part"), F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).cast("long").alias("place")
    )


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each nation."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return orders.withColumn("place", place.cast("long")).where("place <= 3").select("c_nationkey", "place", "o_orderkey", "o_totalprice")


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of items as (breakdown, indicator, value), with each value per hundred of the first."""
    items = table(spark, sf_dir, "lineitem")
    wide = items.groupBy(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("breakdown")).agg(
        F.count("*").alias("items"), F.round(F.sum("l_quantity"), 0).alias("quantity"), F.count_if(F.col("l_discount") > 0.05).alias("discounted")
    )
    long = long_form(wide, "breakdown", ["items", "quantity", "discounted"])
    base = long.where("indicator = 'items'").select("breakdown", F.col("value").alias("base"))
    return long.join(base, "breakdown").select("breakdown", "indicator", "value", F.round(F.col("value") / F.col("base") * 100, 2).alias("per_100"))


def indicator_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which fewer events of one type than of another were seen: a self-join of a long table."""
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    a, b = daily.where("event_type = 'view'"), daily.where("event_type = 'click'")
    joined = a.select("day", F.col("n").alias("views")).join(b.select("day", F.col("n").alias("clicks")), "day")
    return joined.where("views < clicks").select(F.date_format("day", "yyyyMMdd").alias("day"), "views", "clicks")


def size_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by an ordered list of rules, the first that holds wins; null-safe comparisons."""
    name = F.col("p_type")
    kind = (
        F.when(name.rlike("(?iu)^promo"), "promotion")
        .when(name.rlike("(?iu)brushed|polished") & (F.col("p_size") < 25), "small finished")
        .when(name.rlike("(?iu)steel$"), "steel")
        .when(F.col("p_size").between(40, 50), "large")
        .otherwise("other")
    )
    return table(spark, sf_dir, "part").groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n"), F.count_if(~F.nullif(F.col("p_size"), F.lit(1)).eqNullSafe(F.lit(2))).alias("not_two")
    )


def catalog_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and modified customers between two made snapshots."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    before = customer.where("c_custkey % 10 != 3")
    after = customer.where("c_custkey % 10 != 7").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 5, None).otherwise(F.col("c_mktsegment")))
    return snapshot_changes(before, after, "c_custkey", "c_mktsegment")


def stale_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that must be loaded again: failed, unknown or changed."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    status = customer.where("c_custkey % 4 != 0").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 == 0, F.lit("OTHER")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(F.col("c_custkey") % 5 == 0, "error").otherwise("ok").alias("status"),
    )
    return needs_load(customer, status, "c_custkey", ["c_mktsegment"]).select("c_custkey")


def upserted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after later rows have replaced some and added others."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    changed = customer.where("c_custkey % 3 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 1_000_000).otherwise(0)).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"))
    return upsert(customer, changed, ["c_custkey"])


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties by key, guarded against what is no whole number."""
    value = F.get_json_object("props", "$.k")
    number = F.when(value.rlike("^[0-9]+$"), value.cast("long"))
    return table(spark, sf_dir, "events").groupBy((number % 10).alias("digit")).agg(F.count("*").alias("n"), F.sum(number).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        order_status_shares, customers_without_orders, latest_order, price_medians, commonest_priority, quantity_price_correlation,
        nation_lists, large_groups, two_level_totals, orders_per_supplier_set, share_of_total, top_orders, indicators,
        indicator_conflicts, size_classes, catalog_changes, stale_customers, upserted_customers, json_fields,
    )
}

ORACLES = {
    "order_status_shares": """SELECT c_mktsegment, count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open,
       round(count(*) FILTER (o_orderstatus = 'O') / CAST(count(*) AS DOUBLE), 3) AS open_share,
       round(count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') / nullif(CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE), 0), 3) AS urgent_share
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "customers_without_orders": """SELECT c_custkey, 'none' AS kind FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT c_custkey, 'urgent' FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    "latest_order": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC",
    "price_medians": """WITH o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey), l AS (
  SELECT 'city' AS area_kind, 'all' AS area_id, * FROM o UNION ALL SELECT 'segment', c_mktsegment, * FROM o)
SELECT area_kind, area_id, count(*) AS orders, round(quantile_cont(o_totalprice, 0.5), 2) AS median_price,
       round(quantile_cont(o_totalprice, 0.5) FILTER (o_orderstatus = 'O'), 2) AS median_open FROM l WHERE area_id IS NOT NULL GROUP BY 1, 2""",
    "commonest_priority": """WITH n AS (SELECT c_nationkey, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT DISTINCT ON (c_nationkey) c_nationkey, o_orderpriority AS priority, n FROM n ORDER BY c_nationkey, n DESC, o_orderpriority""",
    "quantity_price_correlation": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY 1",
    "nation_lists": """SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, min(n_name) AS first_name,
       CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS keys_json,
       (SELECT string_agg(DISTINCT substr(m.n_name, 1, 1), '' ORDER BY substr(m.n_name, 1, 1)) FROM nation m WHERE m.n_regionkey = nation.n_regionkey) AS initials
FROM nation GROUP BY n_regionkey""",
    "large_groups": """WITH c AS (SELECT p_brand, count(*) AS parts, count(*) FILTER (p_size < 10) AS small FROM part GROUP BY 1)
SELECT * FROM c WHERE parts > 1.1e0 * (SELECT avg(parts) FROM c) AND small > 0""",
    "two_level_totals": """WITH u AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1)
SELECT n_regionkey, CAST(sum(n) AS BIGINT) AS n, max(n) AS most FROM u JOIN nation ON k = n_nationkey GROUP BY 1""",
    "orders_per_supplier_set": """WITH c AS (SELECT p_brand, l_suppkey, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.p_brand, count(DISTINCT b.l_orderkey) AS events FROM (SELECT DISTINCT p_brand, l_suppkey FROM c) a JOIN c b USING (l_suppkey) GROUP BY 1""",
    "share_of_total": """SELECT event_type, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS part,
       row_number() OVER (ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY 1""",
    "top_orders": """SELECT c_nationkey, place, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS place
  FROM orders JOIN customer ON o_custkey = c_custkey) WHERE place <= 3""",
    "indicators": """WITH w AS (SELECT l_returnflag || '-' || l_linestatus AS breakdown, CAST(count(*) AS DOUBLE) AS items,
         round(sum(l_quantity), 0) AS quantity, CAST(count(*) FILTER (l_discount > 0.05e0) AS DOUBLE) AS discounted FROM lineitem GROUP BY 1
), l AS (SELECT breakdown, 'items' AS indicator, items AS value, items AS base FROM w UNION ALL SELECT breakdown, 'quantity', quantity, items FROM w
  UNION ALL SELECT breakdown, 'discounted', discounted, items FROM w)
SELECT breakdown, indicator, value, round(value / base * 100, 2) AS per_100 FROM l""",
    "indicator_conflicts": """WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT strftime(a.day, '%Y%m%d') AS day, a.n AS views, b.n AS clicks FROM d a JOIN d b USING (day)
WHERE a.event_type = 'view' AND b.event_type = 'click' AND a.n < b.n""",
    "size_classes": """SELECT CASE WHEN regexp_matches(p_type, '^promo', 'i') THEN 'promotion'
            WHEN regexp_matches(p_type, 'brushed|polished', 'i') AND p_size < 25 THEN 'small finished'
            WHEN regexp_matches(p_type, 'steel$', 'i') THEN 'steel' WHEN p_size BETWEEN 40 AND 50 THEN 'large' ELSE 'other' END AS kind,
       count(*) AS n, count(*) FILTER (nullif(p_size, 1) IS DISTINCT FROM 2) AS not_two FROM part GROUP BY 1""",
    "catalog_changes": """SELECT c_custkey, CASE c_custkey % 10 WHEN 3 THEN 'added' WHEN 7 THEN 'removed' ELSE 'modified' END AS change
FROM customer WHERE c_custkey % 10 IN (3, 7) OR (c_custkey % 10 = 5 AND c_mktsegment IS NOT NULL)""",
    "stale_customers": """SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 5 = 0 OR (c_custkey % 7 = 0 AND c_mktsegment IS DISTINCT FROM 'OTHER')""",
    "upserted_customers": """SELECT c_custkey, CASE WHEN c_custkey % 6 = 3 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer
UNION ALL SELECT c_custkey + 1000000, 'NEW' FROM customer WHERE c_custkey % 6 = 0""",
    "json_fields": """WITH v AS (SELECT try_cast(regexp_extract(json_extract_string(props, '$.k'), '^[0-9]+$') AS BIGINT) AS k FROM events)
SELECT k % 10 AS digit, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM v GROUP BY 1""",
}
