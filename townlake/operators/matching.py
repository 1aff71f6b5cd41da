"""Matching records of two registers that have no common id."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townlake.functions.geo import distance_m
from townlake.functions.text import similarity, trigrams
from townlake.operators.checkpoints import durable
from townlake.operators.spatial import nearest_k
from townlake.operators.tables import first_per_key


def match_in_passes(left: DataFrame, right: DataFrame, left_id: str, right_id: str, passes: list[tuple[str, list[str]]]) -> DataFrame:
    """(left_id, right_id, match): for each left row the right row of the first pass that has one.

    A pass has a name and the columns that must be equal. Within a pass the lowest right id wins,
    so each pass joins one right row a key, however many rows a key has.
    """
    found = [
        left.select(left_id, *keys)
        .join(right.groupBy(*keys).agg(F.min(right_id).alias("_right")), keys)
        .select(left_id, F.struct(F.lit(place).alias("place"), F.col("_right"), F.lit(name).alias("name")).alias("_best"))
        for place, (name, keys) in enumerate(passes)
    ]
    best = reduce(DataFrame.unionByName, found).groupBy(left_id).agg(F.min("_best").alias("_best"))
    return best.select(left_id, F.col("_best._right").alias(right_id), F.col("_best.name").alias("match"))


def match_unique_prefix(left: DataFrame, right: DataFrame, left_id: str, right_id: str, prefix: str, full: str, block: list[str]) -> DataFrame:
    """(left_id, right_id) where within ``block`` exactly one right ``full`` begins with ``prefix``.

    Right texts are cut to every length of prefix that occurs in their block, so the join is on
    equal keys.
    """
    lengths = left.select(*block, F.length(prefix).alias("_n")).distinct()
    cut = right.join(lengths, block).where(F.length(full) >= F.col("_n"))
    keyed = cut.select(*block, right_id, F.substring(F.col(full), F.lit(1), F.col("_n")).alias("_prefix"))
    unique = (
        keyed.groupBy(*block, "_prefix")
        .agg(F.countDistinct(right_id).alias("_n"), F.min(right_id).alias(right_id))
        .where("_n = 1")
    )
    return left.withColumn("_prefix", F.col(prefix)).join(unique, [*block, "_prefix"]).select(left_id, right_id)


def match_by_trigrams(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: str, right_text: str, least: float = 0.3) -> DataFrame:
    """(left_id, right_id, similarity): the most similar right text above ``least``, lowest id on ties.

    Texts that are alike have a trigram in common among the first of each, in an order that puts
    rare ones first; of n trigrams those are all but ``least`` times n. Only pairs that share such a
    trigram are compared, so trigrams that most texts have make few pairs.
    """
    a, b = left.select(left_id, trigrams(F.col(left_text)).alias("_a")), right.select(right_id, trigrams(F.col(right_text)).alias("_b"))
    of_left, of_right = a.select(left_id, F.explode("_a").alias("_t")), b.select(right_id, F.explode("_b").alias("_t"))
    uses = of_left.select("_t").unionByName(of_right.select("_t")).groupBy("_t").agg(F.count("*").alias("_uses"))

    def leading(rows: DataFrame, key: str) -> DataFrame:
        by_use = F.array_sort(F.collect_list(F.struct("_uses", "_t")))
        ordered = rows.join(uses, "_t").groupBy(key).agg(by_use.alias("_all"))
        n = F.size("_all") - F.ceil(F.size("_all") * F.lit(least)).cast("int") + 1
        return ordered.select(key, F.explode(F.slice("_all", F.lit(1), F.least(n, F.size("_all")))).alias("_first")).select(key, F.col("_first._t").alias("_t"))

    pairs = leading(of_left, left_id).join(leading(of_right, right_id), "_t").select(left_id, right_id).distinct()
    alike = pairs.join(a, left_id).join(b, right_id).withColumn("similarity", similarity(F.col("_a"), F.col("_b")))
    return first_per_key(alike.where(F.col("similarity") > least), [left_id], [F.col("similarity").desc(), F.col(right_id)]).select(
        left_id, right_id, "similarity"
    )


@dataclass(frozen=True)
class Pass:
    """A way to match: a name, columns that must be equal on both sides by name, and perhaps a list of alternatives.

    ``alternatives`` names a left list whose values stand, in their order, for the right column ``of``.
    ``left`` and ``right`` are conditions on rows that take part.
    """

    name: str
    keys: tuple[str, ...]
    alternatives: str | None = None
    of: str | None = None
    left: str = "true"
    right: str = "true"


def match_ranked(left: DataFrame, right: DataFrame, left_id: str, right_id: str, passes: list[Pass], part: str) -> DataFrame:
    """(left_id, right_id, match, place): the best right row of each left row that has one.

    The first pass that has a row counts, then the place among its alternatives (0 for the name itself,
    then from 1), then a row of the same ``part`` (as of an entrance), then one without part (''),
    then any, then the lowest right id. Each choice is a join with one right row a key, however
    many rows a key has. Null keys match nothing, and a null part is like no part.
    """
    part_of = lambda rows: rows.withColumn(part, F.coalesce(F.col(part), F.lit("")))
    left, right, found = part_of(left), part_of(right), []
    for order, p in enumerate(passes):
        rows, keys = left.where(p.left), list(p.keys)
        if p.alternatives:
            rows = rows.select(left_id, part, *p.keys, F.posexplode(p.alternatives).alias("_alt", p.of)).withColumn("_alt", F.col("_alt") + 1)
            keys.append(p.of)
        else:
            rows = rows.select(left_id, part, *keys, F.lit(0).alias("_alt"))
        least = right.where(p.right).groupBy(*keys, part).agg(F.min(right_id).alias("_right"))
        of_any = least.groupBy(*keys).agg(F.min("_right").alias("_right"))
        for choice, met in enumerate((rows.join(least, [*keys, part]), rows.join(least.where(F.col(part) == "").drop(part), keys), rows.join(of_any, keys))):
            best = F.struct(F.lit(order).alias("order"), F.col("_alt").alias("alt"), F.lit(choice).alias("choice"), F.col("_right").alias("right"), F.lit(p.name).alias("name"))
            found.append(met.select(left_id, best.alias("_best")))
    best = reduce(DataFrame.unionByName, found).groupBy(left_id).agg(F.min("_best").alias("_best"))
    return best.select(left_id, F.col("_best.right").alias(right_id), F.col("_best.name").alias("match"), F.col("_best.alt").alias("place"))


def numbers_of(text: Column, longest: int = 200) -> Column:
    """The house numbers of a text as a list: parts between commas, a range of whole numbers by its step.

    A range whose ends are both even or both odd has every second number. One that runs backwards or is
    longer than ``longest`` is no range: it stays as it is written.
    """
    parts = F.filter(F.transform(F.split(text, "[,;]"), lambda p: F.trim(p)), lambda p: p != "")

    def of_part(p: Column) -> Column:
        low, high = (F.regexp_extract(p, r"^(\d{1,9})\s*[-–]\s*(\d{1,9})$", k) for k in (1, 2))
        a, b = (F.when(x != "", x).cast("int") for x in (low, high))
        step = F.when((b - a) % 2 == 0, 2).otherwise(1)
        ranged = F.transform(F.sequence(a, F.greatest(a, b), step), lambda n: n.cast("string"))
        return F.when((low != "") & (b >= a) & (b - a <= longest), ranged).otherwise(F.array(p))

    return F.array_distinct(F.flatten(F.transform(parts, of_part)))


def nearest_of_key(left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: str, kind: str, most: int = 100) -> DataFrame:
    """(left_id, right_id, agrees, distance_m): of the right rows with the same ``key`` the one of the same kind, then the nearest.

    Rows without a place come after those with one, then the lowest right id. A key of at most ``most``
    right rows is a join; within a larger one places are searched by cells in growing rings, once for
    rows of one place, key and kind. So a left row meets few right ones, however many share its key.
    """
    theirs = right.select(F.col(right_id), F.col(key).alias("_key"), F.col(kind).alias("_kind"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    counts = durable(theirs.groupBy("_key").agg(F.count("*").alias("_n")))
    small, large = counts.where(F.col("_n") <= most).select("_key"), counts.where(F.col("_n") > most).select("_key")
    agrees = F.coalesce(F.col(kind) == F.col("_kind"), F.lit(False))
    apart = distance_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    order = F.struct((~agrees).alias("other"), apart.isNull().alias("placeless"), apart.alias("distance_m"), F.col(right_id))
    mine = left.select(left_id, F.col(key).alias("_key"), kind, "lon", "lat")
    best = mine.join(theirs.join(small, "_key"), "_key").groupBy(left_id).agg(F.min(order).alias("_best"))
    found = best.select(left_id, F.col(f"_best.{right_id}").alias(right_id), (~F.col("_best.other")).alias("agrees"), F.col("_best.distance_m").alias("distance_m"))
    if large.isEmpty():
        return found
    many = theirs.join(large, "_key")
    open_ = durable(mine.join(large, "_key"))
    placed = many.where("_lon is not null and _lat is not null").select(right_id, "_key", "_kind", F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))
    for same, fits in ((True, agrees), (False, F.lit(True))):
        at = nearest_k(open_.where("lon is not null and lat is not null"), placed, left_id, right_id, 1, 1000.0, fits, ([kind], ["_kind"]), ["_key"])
        near = at.select(left_id, right_id, F.lit(same).alias("agrees"), "distance_m")
        # Without a place on either side, the lowest id: one right row a key.
        least = many.groupBy("_key", *(["_kind"] if same else [])).agg(F.min(right_id).alias(right_id))
        rest = open_.join(near.select(left_id), left_id, "left_anti").join(least, "_key").where(agrees if same else F.lit(True))
        near = near.unionByName(rest.select(left_id, right_id, F.lit(same).alias("agrees"), F.lit(None).cast("double").alias("distance_m")))
        found = found.unionByName(near)
        open_ = durable(open_.join(near.select(left_id), left_id, "left_anti"))
    return found
