"""Keys of names and numbers, and matching two registers without a common id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townlake.functions.text import name_key, number_key
from townlake.functions.values import decimal_comma, given, whole_number
from townlake.operators.matching import match_by_trigrams, match_in_passes, match_unique_prefix
from townlake.plans.tables import table


def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised names and numbers of parts."""
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        name_key(F.concat_ws(" - ", "p_brand", F.upper("p_name"))).alias("name"),
        number_key(F.concat(F.lit("No. 00"), F.col("p_size").cast("string"), F.lit(" A-"), F.col("p_partkey").cast("string"))).alias("number"),
    )


def guarded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are numbers, or stand for no data, counted by what they give."""
    part = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_partkey") % 5 == 0, " - ").when(F.col("p_partkey") % 5 == 1, "").when(
        F.col("p_partkey") % 5 == 2, F.concat(F.col("p_size").cast("string"), F.lit(",5"))
    ).when(F.col("p_partkey") % 5 == 3, "1e3").otherwise(F.col("p_size").cast("string"))
    kinds = part.select(given(raw, "-", "no data").alias("text"), whole_number(raw).alias("whole"), decimal_comma(raw).alias("number"))
    return kinds.agg(
        F.count("text").alias("given"), F.count("whole").alias("wholes"), F.sum("whole").alias("whole_sum"),
        F.count("number").alias("numbers"), F.round(F.sum("number"), 1).alias("number_sum"),
    )


def supplier_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier for each customer: of the same nation and balance class, else of its nation, else of its class."""
    band = lambda c: F.floor(F.col(c) / 1000).cast("long").alias("band")
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), band("c_acctbal"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), band("s_acctbal"))
    return match_in_passes(left, right, "c_custkey", "s_suppkey", [("both", ["nation", "band"]), ("nation", ["nation"]), ("band", ["band"])])


def _blocks(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    orders = orders.select(
        "o_orderkey", (F.col("o_orderkey") % 10).alias("digit"), F.substring(F.col("o_custkey").cast("string"), 1, 3).alias("short")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 10).alias("digit"), F.col("c_custkey").cast("string").alias("full"))
    return match_unique_prefix(orders, customer, "o_orderkey", "c_custkey", "short", "full", ["digit"])


def unique_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose shortened key fits exactly one customer's key of the same last digit."""
    return _blocks(spark, sf_dir, table(spark, sf_dir, "orders"))


def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation the other name that is most like its own, by trigrams."""
    nation = table(spark, sf_dir, "nation")
    others = nation.where("n_nationkey % 2 = 1").select(F.col("n_nationkey").alias("other"), F.col("n_name").alias("other_name"))
    found = match_by_trigrams(nation.where("n_nationkey % 2 = 0"), others, "n_nationkey", "other", "n_name", "other_name")
    return found.select("n_nationkey", "other", F.round("similarity", 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (part_keys, guarded_values, supplier_matches, unique_blocks, similar_names)}

_TRI = """list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''),
  lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""

ORACLES = {
    "part_keys": r"""SELECT p_partkey, nullif(regexp_replace(lower(p_brand || ' - ' || upper(p_name)), '[^\p{L}\p{N}]+', '', 'g'), '') AS name,
       CAST(p_size AS VARCHAR) || 'a' AS number FROM part""",
    "guarded_values": """WITH r AS (SELECT CASE p_partkey % 5 WHEN 0 THEN ' - ' WHEN 1 THEN '' WHEN 2 THEN p_size || ',5' WHEN 3 THEN '1e3' ELSE CAST(p_size AS VARCHAR) END AS x FROM part)
SELECT count(*) FILTER (trim(x) NOT IN ('', '-')) AS given, count(*) FILTER (regexp_full_match(x, '[0-9]+')) AS wholes,
       CAST(sum(CASE WHEN regexp_full_match(x, '[0-9]+') THEN CAST(x AS BIGINT) END) AS BIGINT) AS whole_sum,
       count(try_cast(replace(trim(x), ',', '.') AS DOUBLE)) AS numbers, round(sum(try_cast(replace(trim(x), ',', '.') AS DOUBLE)), 1) AS number_sum FROM r""",
    "supplier_matches": """WITH c AS (SELECT c_custkey, c_nationkey AS n, floor(c_acctbal / 1000) AS b FROM customer), s AS (SELECT s_suppkey, s_nationkey AS n, floor(s_acctbal / 1000) AS b FROM supplier),
p AS (SELECT c_custkey, s_suppkey, 'both' AS "match", 1 AS k FROM c JOIN s ON c.n = s.n AND c.b = s.b UNION ALL
      SELECT c_custkey, s_suppkey, 'nation', 2 FROM c JOIN s ON c.n = s.n UNION ALL SELECT c_custkey, s_suppkey, 'band', 3 FROM c JOIN s ON c.b = s.b)
SELECT DISTINCT ON (c_custkey) c_custkey, s_suppkey, "match" FROM p ORDER BY c_custkey, k, s_suppkey""",
    "unique_blocks": """SELECT o_orderkey, min(c_custkey) AS c_custkey FROM orders JOIN customer
  ON c_custkey % 10 = o_orderkey % 10 AND starts_with(CAST(c_custkey AS VARCHAR), substr(CAST(o_custkey AS VARCHAR), 1, 3))
GROUP BY o_orderkey HAVING count(DISTINCT c_custkey) = 1""",
    "similar_names": f"""WITH n AS (SELECT n_nationkey, {_TRI.format('n_name')} AS a FROM nation),
p AS (SELECT l.n_nationkey, r.n_nationkey AS other, len(list_intersect(l.a, r.a)) / CAST(len(list_distinct(list_concat(l.a, r.a))) AS DOUBLE) AS s
      FROM n l JOIN n r ON l.n_nationkey % 2 = 0 AND r.n_nationkey % 2 = 1)
SELECT DISTINCT ON (n_nationkey) n_nationkey, other, round(s, 6) AS similarity FROM p WHERE s > 0.3 ORDER BY n_nationkey, s DESC, other""",
}

#: The same query under its other name.
QUERIES["unique_blocks_all"], ORACLES["unique_blocks_all"] = unique_blocks, ORACLES["unique_blocks"]
