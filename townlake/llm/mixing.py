"""Mixing sources to target weights, with DataFrame functions only.

Each row gets a random key from a hash of its id. Rows are cut into key ranges within their
source, sums of whole ranges are added up, and a source is cut exactly where its word budget
ends, after as many whole passes (epochs) as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townlake.llm.common import WORD, durable, running_sums

#: Weights of the sources in code-point order, repeating; passes over a source at most.
WEIGHTS = (1, 2, 3)
MOST_PASSES = 3


def source_targets(sources: DataFrame, weights=WEIGHTS, most_passes: int = MOST_PASSES) -> DataFrame:
    """Add ``target`` to one row per source with ``source`` and ``source_size``.

    All sizes together are shared by weight. A target stops at ``most_passes`` times its source's
    size and the rest is shared anew by weight. In the order of that limit per unit of weight, the
    sources that stop come first: one has stopped if its limit is at or below its share of what
    the sources before it leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1))
    limited = sources.withColumn("weight", weight.cast("double")).withColumn(
        "limit", F.col("source_size").cast("double") * most_passes
    )
    tightest = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    earlier = tightest.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole).cast("double")
    left = total - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    ratio = F.col("limit") / F.col("weight")
    level = limited.withColumn("level", left / weight_left)
    # The level of the first source that does not stop holds for it and for all after it.
    first_open = F.min(
        F.when(ratio > F.col("level"), F.struct(ratio.alias("ratio"), F.col("source").isNull().alias("no_name"), "source", "level"))
    ).over(whole)
    final = level.withColumn("final", first_open["level"])
    stopped = F.col("final").isNull() | (ratio <= F.col("final"))
    return final.select(
        "source",
        "source_size",
        F.when(stopped, F.col("limit")).otherwise(F.col("final") * F.col("weight")).alias("target"),
    )


def mix_sources(docs: DataFrame) -> DataFrame:
    """How many words the mix takes of each row of ``docs``.

    Size is the number of words of the text (null: 0). Returns doc_id, source, size, source_size,
    target and taken; the taken words of a source add up to its target, rounded. A null source is
    a source of its own; rows that share an id are ordered by size; repeated rows are
    interchangeable. An empty table gives no rows, sources without words have target 0.
    """
    sized = durable(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
        )
    )
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    named = targets.withColumn("_name", F.struct("source")).withColumn("_hash", F.xxhash64("source"))
    budgeted = (
        sized.withColumn("_hash", F.xxhash64("source"))
        .join(named.drop("source"), "_hash")
        .where(F.col("source").eqNullSafe(F.col("_name.source")))
        .withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
        .drop("_hash", "_name")
    )
    budget = F.round("target").cast("long")
    whole_passes = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    last_words = F.least("size", budget - whole_passes * F.col("source_size") - F.col("before"))
    return running_sums(budgeted, ["source_key"], "size", "key", ["doc_id", "size"]).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (whole_passes * F.col("size") + F.greatest(F.lit(0), last_words)).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each row as often as it is taken whole.

    The one row of a source at which its budget ends comes with its first words only, joined by
    spaces. Rows without words are kept once: they cost nothing. n_chars, where there is such a
    column, counts the code points of the text returned. Columns may have any names.
    """
    key = ["id", "name", "size"]
    named = lambda doc_id, source: {"id": F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")), "name": F.coalesce(F.concat(F.lit("="), source), F.lit(""))}
    taken = mix_sources(docs.select("doc_id", "source", "text")).withColumns(named(F.col("doc_id"), F.col("source"))).groupBy(*key).agg(
        F.sort_array(F.collect_list("taken"), False).alias("taken")
    )
    # The row waits in a struct, so its names meet none of those made here.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row.text")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    repeats = Window.partitionBy(*key).orderBy(*key)
    rows = (
        whole.withColumns({"size": size, **named(F.col("row.doc_id"), F.col("row.source"))})
        .join(taken, key)
        .withColumn("nth", F.row_number().over(repeats))
        .withColumn("words", F.element_at("taken", F.col("nth")))
    )
    full = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.expr("words div size"))
    rest = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("words") % F.col("size"))
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), full.cast("int")),
        F.when(rest > 0, F.array(rest.cast("long"))).otherwise(F.array().cast("array<bigint>")),
    )
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), F.lit(1), F.col("first").cast("int")), " ")
    out = rows.withColumn("first", F.explode(copies)).withColumn("new_text", F.when(F.col("first") < 0, text).otherwise(cut))
    changed = {"text": F.col("new_text"), "n_chars": F.when(F.col("first") < 0, F.col("row.n_chars")).otherwise(F.length("new_text")) if "n_chars" in docs.columns else None}
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
