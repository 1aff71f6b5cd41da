"""Exact deduplication by a tree merge of sorted digest runs.

Every partition of the input makes a run: its digests in order, one row for each, with the number
of its rows and the smallest identifier. In rounds, runs whose numbers differ in one digit exchange
rows: the run whose digit is k gets the digests whose digit of that round is k, from all FAN_IN runs,
and merges them. After a round for each digit, a run holds all of its share of the digests and no
other run has any of those. Every run is written before the next round. A digest that a third of
all rows have is one row of each run, at every level. Rows merge only if the SHA-256, a second hash
and the length of the normalised text all agree, so each level's smallest identifier is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townlake.llm.common import durable, text_or_empty, without_spaces

FAN_IN = 8
IDENTITY = ("digest", "second_hash", "n_kept_chars")
#: What orders the rows of one digest: the smallest stays.
RANK = ("less_chars", "no_id", "doc_id", "row")


def _text_identity(text: Column) -> list[Column]:
    normal = without_spaces(text)
    return [
        F.unhex(F.sha2(normal, 256)).alias("digest"),
        F.xxhash64(normal).alias("second_hash"),
        F.length(normal).alias("n_kept_chars"),
    ]


def merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (run, IDENTITY) of rows in that order and then by RANK: the first, with all counts.

    Only one row is held from batch to batch. Neighbours merge if all of their identity agrees.
    """
    held: list[pa.Array] = []
    for batch in batches:
        names, count = batch.schema.names, batch.schema.get_field_index("group_size")
        columns = [pa.concat_arrays([h, c]) for h, c in zip(held, batch.columns, strict=True)] if held else batch.columns
        keys = list(zip(*(c.to_pylist() for c in columns[: 1 + len(IDENTITY)]), strict=True))
        starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        if not starts:
            continue
        size = columns[count].to_pylist()
        sums = [sum(size[a:b]) for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]
        merged = [pa.array(sums, pa.int64()) if k == count else c.take(pa.array(starts)) for k, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([c[:-1] for c in merged], names)
        held = [c[-1:] for c in merged]
    if held:
        yield pa.RecordBatch.from_arrays(held, names)


def _merged(rows: DataFrame) -> DataFrame:
    return durable(rows.sortWithinPartitions("run", *IDENTITY, *RANK).mapInArrow(merge_sorted, rows.schema))


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per digest: ``group_size`` and the columns of RANK of its smallest row.

    ``rows`` has ``run`` (its number, from 0), the columns of IDENTITY and of RANK.
    """
    columns = ["run", *IDENTITY, *RANK, "group_size"]
    runs = _merged(rows.withColumn("group_size", F.lit(1).cast("long")).select(*columns))
    left, place = rows.rdd.getNumPartitions(), 1
    while left > 1:
        digit, own = (F.expr(f"({of} div {place}) % {fan_in}") for of in (f"pmod(second_hash, {1 << 62})", "run"))
        target = F.col("run") + (digit - own) * place
        runs = _merged(runs.withColumn("run", target.cast("long")).repartition("run"))
        left, place = -(-left // fan_in), place * fan_in
    return runs.drop("run")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Which row stays of every group of equal texts.

    Texts are equal if they are so without white space; null counts as empty. The row with the
    most code points stays, then the smallest doc_id (null last), then the first row read, so of
    repeated rows one stays. Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256. An empty table gives none; other columns of ``docs`` are not read.
    """
    text = text_or_empty()
    rows = durable(
        docs.select(
            "doc_id",
            F.spark_partition_id().cast("long").alias("run"),
            (-F.length(text)).alias("less_chars"),
            F.col("doc_id").isNull().alias("no_id"),
            F.monotonically_increasing_id().alias("row"),
            *_text_identity(text),
        )
    )
    best = merge_runs(rows).select(*IDENTITY, "group_size", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    return rows.join(best, list(IDENTITY)).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names."""
    kept = exact_duplicates(docs).where("kept").select(F.xxhash64("doc_id").alias("id_hash"), F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("digest"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    tagged = docs.select(
        whole.alias("whole"), F.unhex(F.sha2(without_spaces(text_or_empty()), 256)).alias("digest"), F.xxhash64("doc_id").alias("id_hash"),
        F.col("doc_id").alias("own_id"), F.length(text_or_empty()).alias("chars"),
    )
    matched = tagged.join(kept, ["id_hash", "digest"]).where(F.col("own_id").eqNullSafe(F.col("kept_id")))
    # Repeated rows share id and digest: the join keeps their partitioning, one of them stays.
    repeats = Window.partitionBy("id_hash", "digest").orderBy(F.desc("chars"))
    return matched.withColumn("repeat", F.row_number().over(repeats)).where("repeat = 1").select("whole.*")
