"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Every shingle of five words is hashed once. The top bits of a hash name its bin, the smallest hash
of a bin is the bin's value. An empty bin takes the value of another bin that a hash of the empty
bin and an attempt number picks, attempt by attempt until it hits a filled one (optimal
densification), so equal sets fill alike and empty bins draw independently of each other. The low
bits of the values are packed; chance agreement of those few bits is taken out of a likeness.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townlake.llm.common import SPACES, durable, text_or_empty

SHINGLE_WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
#: Attempts to fill an empty bin that are made one by one. All later ones are made at once: each filled
#: bin has one, and the earliest wins, so there is no last attempt.
ATTEMPTS = 12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, none for an empty one."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def shingle_hashes(text: Column) -> Column:
    """A hash for each run of five words; fewer words make one shingle, no words none."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    many = lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - (SHINGLE_WORDS - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(SHINGLE_WORDS)))
    )
    return let(
        hashes,
        lambda h: F.when(F.size(h) >= SHINGLE_WORDS, many(h))
        .when(F.size(h) > 0, F.array(F.xxhash64(h)))
        .otherwise(F.array().cast("array<bigint>")),
    )


def _bin(hash_value: Column) -> Column:
    return F.shiftright(hash_value, 64 - BIN_BITS)


def bin_minima(hashes: Column) -> Column:
    """The smallest hash of each of the BINS bins, null for an empty bin."""
    first_of_bin = lambda s: F.filter(
        s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))
    )
    by_bin = let(
        F.sort_array(hashes), lambda s: let(first_of_bin(s), lambda f: F.map_from_arrays(F.transform(f, _bin), f))
    )
    return let(
        by_bin, lambda m: F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: m[b.cast("bigint")])
    )


def densified(minima: Column) -> Column:
    """Fill empty bins; ``minima`` has at least one filled bin."""

    def fill(v: Column, filled: Column, value: Column, b: Column) -> Column:
        tries = [F.get(v, F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(ATTEMPTS)]
        later = F.array_min(F.transform(filled, lambda x: F.struct(F.xxhash64(b, x["bin"], F.lit(ATTEMPTS)), x["value"].alias("value"))))
        return F.coalesce(value, *tries, later["value"])

    placed = lambda v: F.filter(F.transform(v, lambda x, i: F.struct(i.alias("bin"), x.alias("value"))), lambda x: x["value"].isNotNull())
    return let(minima, lambda v: let(placed(v), lambda f: F.transform(v, lambda value, b: fill(v, f, value, b))))


def fingerprint(text: Column) -> Column:
    """BINS times LOW_BITS bits as hexadecimal digits; an empty string for a text without words."""
    low = lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND(F.lit((1 << LOW_BITS) - 1)))), LOW_BITS // 4, "0")
    return let(
        shingle_hashes(text),
        lambda h: F.when(F.size(h) == 0, F.lit("")).otherwise(
            F.array_join(F.transform(densified(bin_minima(h)), low), "")
        ),
    )


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints' shingles, 0 to 1.

    The share of equal packed values, less the share that agrees by chance. Two texts without
    words are alike, one without words is like no other.
    """
    digits = LOW_BITS // 4
    place = lambda f, i: F.substring(f, i * digits + 1, F.lit(digits))
    agree = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: place(one, i) == place(other, i)))
    chance = 1.0 / (1 << LOW_BITS)
    estimate = F.greatest(F.lit(0.0), (agree / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((one == "") | (other == ""), (one == other).cast("double")).otherwise(estimate)


def previous_documents(ids: DataFrame) -> DataFrame:
    """Add prev_key, prev_tag, prev_chars of the row before by (key, tag), of the last for the first.

    Rows are sorted in ranges; the row before the first of a range is the last of the range
    before, found in a table with one row a range.
    """
    ranged = durable(ids.repartitionByRange("key", "tag").withColumn("part", F.spark_partition_id()))
    row = F.struct("key", "tag", "n_chars")
    lasts = ranged.groupBy("part").agg(F.max(row).alias("last"))
    parts = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before_part = lasts.select(
        "part", F.coalesce(F.lag("last").over(parts), F.last("last").over(whole)).alias("before")
    )
    in_part = Window.partitionBy("part").orderBy("key", "tag")
    return (
        ranged.join(before_part, "part")
        .withColumn("prev", F.coalesce(F.lag(row).over(in_part), F.col("before")))
        .select(
            "key",
            "tag",
            F.col("prev.key").alias("prev_key"),
            F.col("prev.tag").alias("prev_tag"),
            F.col("prev.n_chars").alias("prev_chars"),
        )
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    The edited text has the last half of its code points replaced by the first as many of the next
    document's, in the order of doc_id (null last), after the last the first. A null text is
    empty. Rows that share a doc_id follow each other by a hash of their text; repeated rows are
    one place in that order and each gets a result. A single document is its own next one; an
    empty table gives no rows. Ids may be of any type that has an order.
    """
    text = text_or_empty()
    # Both uses of the texts below take these same columns, so they are shuffled once.
    texts = docs.select(
        F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")).alias("key"),
        F.md5(text).alias("tag"),
        text.alias("text"),
    )
    places = texts.select("key", "tag", F.length("text").alias("n_chars")).distinct()
    repeats = Window.partitionBy("key", "tag").orderBy("key", "tag")
    heads = (
        texts.join(previous_documents(places), ["key", "tag"])
        .withColumn("repeat", F.row_number().over(repeats))
        .where("repeat = 1")
        .select(
            F.col("prev_key").alias("key"),
            F.col("prev_tag").alias("tag"),
            F.expr("substring(text, 1, prev_chars div 2)").alias("head"),
            fingerprint(F.col("text")).alias("next_fingerprint"),
        )
    )
    edited = (
        texts.join(heads, ["key", "tag"])
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), head)"))
        .select(
            F.col("key.id").alias("doc_id"),
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            fingerprint(F.col("text")).alias("fingerprint"),
            fingerprint(F.col("edited")).alias("edited_fingerprint"),
            "next_fingerprint",
        )
    )
    return edited.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
