"""Labelled documents to fit a classifier on: all of them, or a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(modulus: int, remainder: int):
    """The rows that a classifier is measured on: they never lend it their labels."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(True))


#: Bytes of the texts of a sample, at most: they go to the driver.
MOST_BYTES = 64 << 20
#: Labels up to which they are sent to every task; more are joined.
MOST_SENT = 1_000_000


def known_labels(labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    """(doc_id, label) of the rows that are not held out; nulls are left out, a document with two labels has the smaller one."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(modulus, remainder))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
    )


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, also: tuple[str, ...] = (), most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, text, label) and the columns ``also`` of all documents with a label, without held-out rows."""
    known = known_labels(labels, label, modulus, remainder)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *also)
    return texts.join(F.broadcast(known) if known.count() <= most_sent else known, "doc_id")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int, most_bytes: int = MOST_BYTES, also: tuple[str, ...] = ()
) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` documents of each label, and how many labels of each class there are.

    Returns (doc_id, text, label) and the columns ``also``, without held-out rows: those with the
    smallest hashes of their ids. A class's texts have at most half of ``most_bytes`` together;
    those that do not fit are left out. Null ids and null labels are left out; a repeated label
    counts once, a document with two labels has the smaller one.
    """
    known = known_labels(labels, label, modulus, remainder)
    counts = {int(r["label"]): r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(order).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *also)
    chosen = F.broadcast(chosen)  # at most 2 * per_class narrow rows
    sized = texts.select("doc_id", F.octet_length("text").alias("bytes")).join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.sum("bytes").alias("bytes"))
    left, fitting = {0: most_bytes // 2, 1: most_bytes // 2}, []
    for r in sized.orderBy(order).collect():  # at most 2 * per_class narrow rows
        if r["bytes"] <= left[r["label"]]:
            left[r["label"]] -= r["bytes"]
            fitting.append((r["doc_id"], r["label"]))
    schema = docs.select("doc_id").schema.add("label", "integer")
    return texts.join(F.broadcast(docs.sparkSession.createDataFrame(fitting, schema)), "doc_id"), counts
