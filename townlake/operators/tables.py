"""Keyed tables: latest rows, upserts, differences, list differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townlake.operators.checkpoints import durable


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``, which should end with something unique."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def upsert(current: DataFrame, incoming: DataFrame, key: Sequence[str], arrival: Sequence[Column] = ()) -> DataFrame:
    """``current`` with rows of equal key replaced by ``incoming`` and new keys added.

    Of several incoming rows of a key the first in ``arrival`` is taken.
    """
    newest = first_per_key(incoming, key, arrival) if arrival else incoming.dropDuplicates(list(key))
    return current.join(newest.select(*key), list(key), "left_anti").unionByName(newest)


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, version: str) -> DataFrame:
    """(key, change): added, removed or modified rows between two states of a catalog."""
    old = before.select(F.col(key), F.col(version).alias("_old"), F.lit(True).alias("_was"))
    new = after.select(F.col(key), F.col(version).alias("_new"), F.lit(True).alias("_is"))
    change = (
        F.when(F.col("_was").isNull(), "added")
        .when(F.col("_is").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    )
    return old.join(new, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def needs_load(catalog: DataFrame, status: DataFrame, key: str, compared: Sequence[str], good: Sequence[str] = ("ok",)) -> DataFrame:
    """Catalog rows that were never loaded well, or whose compared columns have changed since."""
    known = status.where(F.col("status").isin(*good)).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in compared])
    same = F.col(key) == F.col("_key")
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return catalog.join(known, same, "left_anti")


#: Places of an event, and of a set, up to which pairs of them are looked at; pairs that are sent to every task, at most.
FEW_PLACES, SENT_PAIRS = 12, 2_000_000


def _pairs_of(places: str) -> Column:
    """The pairs (_a, _b) of a sorted list, the lesser first."""
    later = lambda a, i: F.transform(F.slice(places, i + 2, F.size(places)), lambda b: F.struct(a.alias("_a"), b.alias("_b")))
    return F.inline(F.flatten(F.transform(places, later)))


def set_counts(members: DataFrame, events: DataFrame, member: str, place: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """(member, *by, events): distinct events at any of a member's places, for each kind ``by`` of events.

    ``members`` has (member, place), ``events`` (place, event, *by). Members with the same set of places
    share one count. In a set with fewer pairs of places than calls the places' own counts are added up, less
    one for each further place of an event: of events at a few places only the pairs that some set holds
    are looked at, events at many places meet the sets of each. A set of more pairs meets all its calls.
    """
    sets = durable(
        members.select(member, place).distinct().groupBy(member).agg(F.array_sort(F.collect_list(place)).alias("_places"))
        .withColumn("_same", F.sha2(F.to_json("_places"), 256))
    )
    kinds = durable(sets.groupBy("_same").agg(F.first("_places").alias("_places")).withColumn("_set", F.monotonically_increasing_id()))
    # Dealt by event: distinct rows, counts and lists of an event need no further shuffle.
    calls = events.select(place, event, *by).repartition(event).distinct()
    held = durable(calls.groupBy(place, *by).agg(F.count("*").alias("_n")))
    sums = durable(kinds.select("_set", F.explode("_places").alias(place)).join(held, place).groupBy("_set", *by).agg(F.sum("_n").alias("_sum")))
    size = F.size("_places").cast("long")
    chosen = kinds.join(sums.groupBy("_set").agg(F.sum("_sum").alias("_calls")), "_set")
    few_pairs = size * (size - 1) / 2 <= F.greatest(F.col("_calls"), F.lit(FEW_PLACES * (FEW_PLACES - 1) // 2))
    chosen = durable(chosen.withColumn("_few", few_pairs))

    few = chosen.where("_few")
    pairs = few.select("_set", _pairs_of("_places"))
    wanted = durable(pairs.select("_a", "_b").distinct())
    counted = calls.withColumn("_m", F.count("*").over(Window.partitionBy(event, *by))).where("_m > 1")
    lists = counted.where(F.col("_m") <= FEW_PLACES).groupBy(event, *by).agg(F.array_sort(F.collect_list(place)).alias("_at"))
    both = lists.select(event, *by, _pairs_of("_at")).join(F.broadcast(wanted) if wanted.count() <= SENT_PAIRS else wanted, ["_a", "_b"], "left_semi")
    # An event at k places of a set is at k (k - 1) / 2 of its pairs.
    met = both.join(pairs, ["_a", "_b"]).groupBy("_set", event, *by).agg(F.count("*").alias("_pairs"))
    further = met.select("_set", *by, (F.round((F.sqrt(1 + 8 * F.col("_pairs")) - 1) / 2)).cast("long").alias("_k"))
    long = counted.where(F.col("_m") > FEW_PLACES).join(few.select("_set", F.explode("_places").alias(place)), place)
    further = further.unionByName(long.groupBy("_set", event, *by).agg((F.count("*") - 1).alias("_k")).select("_set", *by, "_k"))
    further = further.groupBy("_set", *by).agg(F.sum("_k").alias("_further"))
    found = sums.join(few.select("_set"), "_set").join(further, ["_set", *by], "left").select("_set", *by, (F.col("_sum") - F.coalesce("_further", F.lit(0))).alias("events"))

    many = chosen.where("not _few")
    if not many.isEmpty():
        at = many.select("_set", F.explode("_places").alias(place))
        found = found.unionByName(at.join(calls, place).select("_set", event, *by).distinct().groupBy("_set", *by).agg(F.count("*").alias("events")))
    return sets.join(kinds.select("_same", "_set"), "_same").join(found, "_set").select(member, *by, "events")


def long_form(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, indicator, value): one row for each of ``columns`` that is not null."""
    return rows.unpivot(key, [F.col(c).cast("double").alias(c) for c in columns], "indicator", "value").where("value is not null")


def defined_values(rows: DataFrame, definitions: DataFrame, key: str, properties: str) -> DataFrame:
    """(key, indicator, value): what ``definitions`` (indicator, field, factor, base) say of each row's ``properties``.

    Properties are a map of texts. A value is its field times its factor, by the base if one is named; fields
    that are no number, and bases that are none or 0, give no row. One scan, whatever the number
    of definitions: rows are unfolded and meet them by name.
    """
    number = lambda c: c.try_cast("double")
    unfolded = rows.select(key, properties, F.explode(F.map_entries(properties)).alias("_e")).select(key, properties, F.col("_e.key").alias("field"), number(F.col("_e.value")).alias("_v"))
    met = unfolded.join(definitions, "field")
    base = F.when(F.col("base").isNull(), F.lit(1.0)).otherwise(F.nullif(number(F.try_element_at(properties, F.col("base"))), F.lit(0.0)))
    return met.withColumn("value", F.col("_v") * F.col("factor") / base).where("value is not null").select(key, "indicator", "value")
