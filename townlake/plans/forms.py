"""Forms of expressions and aggregates: cleaning, lists, dates, JSON, gates, modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townlake.functions.forms import day_of, half_even, json_kind, street_key, whole_array
from townlake.plans.tables import table


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders written in three ways, read again and counted by month; other texts give none."""
    day = F.col("o_orderdate").cast("date")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    written = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "dd.MM.yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 4 == 2, serial).otherwise(F.lit("soon"))
    )
    months = table(spark, sf_dir, "orders").select(F.date_format(F.trunc(day_of(written), "month"), "yyyy-MM").alias("month"))
    return months.groupBy("month").agg(F.count("*").alias("n"))


def brand_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest size of each brand (the smaller of equals), whether all are cheap, and the mean of the distinct sizes."""
    sizes = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("dearest"))
    return sizes.groupBy("p_brand").agg(
        F.max_by("p_size", F.struct("n", -F.col("p_size"))).alias("commonest"),
        F.bool_and(F.col("dearest") < 1800).alias("all_cheap"),
        F.round(F.avg("p_size"), 6).alias("mean_size"),
    )


def gated_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of balances by nation, null where over a tenth of the rows withhold theirs (here: below -800)."""
    given = F.when(F.col("c_acctbal") >= -800, F.col("c_acctbal"))
    sums = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("rows"), F.count(given).alias("given"), F.sum(given).alias("total"))
    return sums.select("c_nationkey", F.when(F.col("given") >= 0.9 * F.col("rows"), F.round("total", 2)).alias("balance"), (F.col("rows") - F.col("given")).alias("withheld"))


def mean_of_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price for each part and supplier: the mean of the repeated rows, halves of cents to the even neighbour."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    repeats = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.avg(unit).alias("mean"), F.count("*").alias("n"))
    return repeats.where("n > 1").groupBy("l_suppkey").agg(F.count("*").alias("pairs"), F.round(F.sum("mean"), 1).alias("total"), F.sum(half_even(F.col("n") / 2)).cast("long").alias("halves"))


def order_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by rules in order: of a customer in debt, not (urgent and open), what is left."""
    debt = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("in_debt"))
    orders = table(spark, sf_dir, "orders").join(debt, "o_custkey", "left")
    urgent = F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority").startswith("1"))  # unknown for some
    rule = F.when(F.col("in_debt"), "debt").when(~(urgent & (F.col("o_orderstatus") == "O")), "calm").when(urgent.isNull(), "unknown").otherwise("urgent")
    return orders.groupBy(rule.alias("class")).agg(F.count("*").alias("n"))


def segment_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by the sorted list of their markets: list tests, positions, set differences."""
    lists = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("markets"))
    some = F.array(F.lit("BUILDING"), F.lit("MACHINERY"))
    return lists.select(
        "c_nationkey",
        F.array_join("markets", "+").alias("markets"),
        F.arrays_overlap("markets", some).alias("any"),
        (F.size(F.array_except(some, F.col("markets"))) == 0).alias("all"),
        F.array_position("markets", "HOUSEHOLD").cast("long").alias("place"),
        F.size(F.array_except("markets", some)).cast("long").alias("others"),
        F.array_join(F.array_sort("markets", lambda a, b: F.length(a) - F.length(b)), "+").alias("by_length"),
    )


def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of what the JSON of events holds, and the texts with a key taken out and one put in."""
    events = table(spark, sf_dir, "events").select(
        "event_id", F.map_concat(F.map_filter(F.from_json("props", "map<string, string>"), lambda k, _: k != "k"), F.create_map(F.lit("type"), F.col("event_type"))).alias("kept"),
        json_kind(F.col("props")).alias("kind"), json_kind(F.col("props"), "$.k").alias("inner"), json_kind(F.col("props"), "$.none").alias("missing"),
    )
    return events.groupBy("kind", "inner", "missing", F.to_json("kept").alias("kept")).agg(F.count("*").alias("n"))


def street_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the key of a street made of their priority and number, written in four ways."""
    number = (F.col("o_orderkey") % 9 + 1).cast("int")
    roman = F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))), number)
    name = F.substring("o_orderpriority", 3, 20)
    way = F.col("o_orderkey") % 4
    text = (
        F.when(way == 0, F.concat(F.lit("ул. "), name, F.lit(" "), roman)).when(way == 1, F.concat(F.lit("бул."), F.upper(name), F.lit("-"), number.cast("string")))
        .when(way == 2, F.concat(name, F.lit("  "), F.lower(roman))).otherwise(F.concat(F.lit('пл. "'), name, F.lit('" '), number.cast("string")))
    )
    return table(spark, sf_dir, "orders").groupBy(street_key(text).alias("street")).agg(F.count("*").alias("n"))


def text_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matches, whole words, parts of a text from a place on, and numbers out of lists, by brand."""
    name = F.col("p_type")
    return (
        table(spark, sf_dir, "part")
        .select(
            F.regexp_replace(F.col("p_brand"), "^([^#]*)#", "$1 No ").alias("brand"),
            F.regexp_extract("p_brand", r"(\d)\d*$", 1).alias("digit"),
            name.rlike(r"(?i)\b(tin|steel)\b").alias("metal"),
            F.substring(name, F.lit(4), F.length(name)).alias("tail"),
            F.aggregate(whole_array(F.concat_ws(",", F.col("p_size").cast("string"), F.lit("x"), F.lit(" 7 "))), F.lit(0).cast("long"), lambda a, x: a + x).alias("sum"),
        )
        .groupBy("brand", "digit", "metal")
        .agg(F.count("*").alias("n"), F.min("tail").alias("tail"), F.sum("sum").alias("sum"))
    )


def hours_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour of the day, hours without any too, and the share of the hours so far."""
    hours = spark.range(24).select(F.col("id").alias("hour"))
    counts = table(spark, sf_dir, "events").groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    full = hours.join(counts, "hour", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    so_far = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 24 rows
    whole = Window.partitionBy(F.lit(1))
    return full.select("hour", "n", F.round(F.sum("n").over(so_far) / F.sum("n").over(whole), 4).alias("so_far"))


QUERIES = {
    f.__name__: f
    for f in (order_days, brand_modes, gated_balances, mean_of_repeats, order_classes, segment_lists, event_fields, street_keys, text_patterns, hours_of_day)
}

ORACLES = {
    "order_days": """SELECT CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m') END AS month, count(*) AS n FROM orders GROUP BY 1""",
    "brand_modes": """WITH s AS (SELECT p_brand, p_size, count(*) AS n, max(p_retailprice) AS d FROM part GROUP BY 1, 2)
SELECT p_brand, arg_max(p_size, n * 1000 - p_size) AS commonest, bool_and(d < 1800) AS all_cheap, round(avg(p_size), 6) AS mean_size FROM s GROUP BY 1""",
    "gated_balances": """SELECT c_nationkey, CASE WHEN count(*) FILTER (c_acctbal >= -800) >= 0.9 * count(*) THEN round(sum(c_acctbal) FILTER (c_acctbal >= -800), 2) END AS balance,
       count(*) FILTER (c_acctbal < -800) AS withheld FROM customer GROUP BY 1""",
    "mean_of_repeats": """WITH r AS (SELECT l_partkey, l_suppkey, avg(l_extendedprice / l_quantity) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
SELECT l_suppkey, count(*) AS pairs, round(sum(m), 1) AS total, CAST(sum(round_even(n / 2.0, 0)) AS BIGINT) AS halves FROM r GROUP BY 1""",
    "order_classes": """SELECT CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'debt'
            WHEN NOT (u AND o_orderstatus = 'O') THEN 'calm' WHEN u IS NULL THEN 'unknown' ELSE 'urgent' END AS class, count(*) AS n
FROM (SELECT *, CASE WHEN o_orderkey % 7 > 0 THEN starts_with(o_orderpriority, '1') END AS u FROM orders) GROUP BY 1""",
    "segment_lists": """WITH l AS (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS m FROM customer GROUP BY 1)
SELECT c_nationkey, array_to_string(m, '+') AS markets, list_has_any(m, ['BUILDING', 'MACHINERY']) AS "any", list_has_all(m, ['BUILDING', 'MACHINERY']) AS "all",
       CAST(coalesce(list_position(m, 'HOUSEHOLD'), 0) AS BIGINT) AS place, CAST(len(list_filter(m, lambda x: x NOT IN ('BUILDING', 'MACHINERY'))) AS BIGINT) AS others,
       (SELECT string_agg(x, '+' ORDER BY length(x), x) FROM (SELECT unnest(m) AS x)) AS by_length FROM l""",
    "event_fields": """SELECT lower(json_type(props)) AS kind, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' ELSE lower(json_type(props, '$.k')) END AS "inner",
       CAST(NULL AS VARCHAR) AS missing, '{"type":"' || event_type || '"}' AS kept, count(*) AS n FROM events GROUP BY ALL""",
    "street_keys": r"""SELECT regexp_replace(lower(substr(o_orderpriority, 3, 20)), '[^\p{L}\p{N}]+', '', 'g') || (o_orderkey % 9 + 1) AS street, count(*) AS n FROM orders GROUP BY 1""",
    "text_patterns": r"""SELECT regexp_replace(p_brand, '^([^#]*)#', '\1 No ') AS brand, regexp_extract(p_brand, '(\d)\d*$', 1) AS digit, regexp_matches(p_type, '(?i)\b(tin|steel)\b') AS metal,
       count(*) AS n, min(substr(p_type, 4)) AS tail, CAST(sum(p_size + 7) AS BIGINT) AS sum FROM part GROUP BY 1, 2, 3""",
    "hours_of_day": """WITH h AS (SELECT r.range AS hour, count(ts) AS n FROM range(24) r LEFT JOIN events ON hour(ts) = r.range GROUP BY 1)
SELECT hour, n, round(sum(n) OVER (ORDER BY hour) / CAST(sum(n) OVER () AS DOUBLE), 4) AS so_far FROM h""",
}
