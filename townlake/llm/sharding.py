"""Sharding by balanced label propagation.

Rows that share a link (here: equal texts) should share a shard. Every linked row starts in a
random shard; in rounds of joins it votes for the shard that holds most rows of its links and
moves there if the quota of that move allows: as many rows as want the way back, plus a part of
the room left in the shard. Rows without links then fill the shards up to exactly even counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townlake.llm.common import durable, running_sums, session, stored, text_or_empty

SHARDS = 8
ROUNDS = 5
#: Parts in which the rows of a link meet what is known of it, so that a common link is no single task.
SALTS = 16


def _tie(shard: str, link: str = "link") -> Column:
    """Rows of one link prefer the same of several equal shards, other links another."""
    return F.xxhash64(link, shard)


def _salted(rows: DataFrame, of_links: DataFrame) -> DataFrame:
    """``rows`` (vertex, link, ...) joined to ``of_links`` by link, those of one link in SALTS parts."""
    own = F.pmod(F.xxhash64("vertex"), F.lit(SALTS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.withColumn("salt", own).join(of_links.withColumn("salt", copies), ["link", "salt"]).drop("salt")


def propose_moves(members: DataFrame, labels: DataFrame) -> DataFrame:
    """vertex, shard, to: the rows whose links have most rows in another shard.

    ``members`` has (vertex, link, key), ``labels`` (vertex, shard). A link's rows are counted by
    shard before they meet their members, so a link sends at most one row a shard to each member.
    """
    placed = members.join(labels, "vertex")
    counts = placed.groupBy("link", F.col("shard").alias("to")).agg(F.count("*").alias("rows"))
    votes = (
        _salted(placed, counts)
        .groupBy("vertex", "to")
        .agg(
            F.sum("rows").alias("rows"),
            F.first("shard").alias("shard"),
            F.min("link").alias("link"),
            F.first("key").alias("key"),
        )
    )
    best = F.max_by("to", F.struct("rows", _tie("to"), "to"))
    return (
        votes.groupBy("vertex")
        .agg(best.alias("to"), F.first("shard").alias("shard"), F.min("link").alias("link"), F.first("key").alias("key"))
        .where("to != shard")
    )


def _link_key(link: str = "link", key: str = "key") -> Column:
    """A random key that keeps the rows of a link in one of 256 ranges, spread over 256 parts of it."""
    return F.concat(F.substring(F.md5(link), 1, 2), F.substring(key, 1, 2), F.md5(link), F.col(key))


def _quotas(wanted: dict[tuple[int, int], int], room: list[int]) -> list[tuple[int, int, int]]:
    """Rows that may move between two shards: those that swap, and a fair part of the room."""
    swaps = {(a, b): min(n, wanted.get((b, a), 0)) for (a, b), n in wanted.items()}
    more = {way: n - swaps[way] for way, n in wanted.items()}
    quotas = []
    for (a, b), n in wanted.items():
        all_more = sum(x for (_, to), x in more.items() if to == b)
        part = room[b] * more[a, b] // all_more if all_more else 0
        quotas.append((a, b, min(n, swaps[a, b] + part)))
    return quotas


def propagate(members: DataFrame, rows: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(vertex, shard, link, key) of all linked vertices after at most ``rounds`` rounds."""
    spark = session(members)
    labels = stored(
        members.groupBy("vertex")
        .agg(F.first("key").alias("key"), F.min("link").alias("link"))
        .withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")),
        "labels",
    )
    for _ in range(rounds):
        moves = stored(propose_moves(members, labels.select("vertex", "shard")), "moves")
        # At most shards * shards rows reach the driver.
        wanted = {(r["shard"], r["to"]): r["n"] for r in moves.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}
        if not wanted:
            break
        held = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        room = [max(0, rows // shards - held.get(s, 0)) for s in range(shards)]
        quotas = spark.createDataFrame(_quotas(wanted, room), "shard int, to int, quota long")
        ranked = running_sums(
            moves.select("vertex", "shard", "to", _link_key().alias("key"), F.lit(1).alias("one")),
            ["shard", "to"], "one", "key", ["vertex"], digits=4,
        )
        accepted = ranked.join(F.broadcast(quotas), ["shard", "to"]).where("before < quota").select("vertex", "to")
        moved = labels.join(accepted, "vertex", "left").select("vertex", "key", "link", F.coalesce("to", "shard").alias("shard"))
        labels = stored(moved, "labels")
    return labels


def even_shards(vertices: DataFrame, members: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(vertex, shard, slot): counts of the shards differ by one at most, slots count from 0.

    ``vertices`` has (vertex, key) with a unique vertex and a random hexadecimal key, ``members``
    (vertex, link, key) with every link shared by at least two vertices. Linked rows beyond a
    shard's even count, link by link, and all rows without links fill what the others leave.
    """
    total = vertices.count()
    even = [total // shards + (s < total % shards) for s in range(shards)]
    labels = propagate(members, total, shards, rounds)
    even_count = F.element_at(F.array(*map(F.lit, even)), F.col("shard") + 1)
    ranked = durable(
        running_sums(
            labels.withColumn("key", _link_key()).withColumn("one", F.lit(1)), ["shard"], "one", "key", ["vertex"], digits=4
        )
    )
    stay = ranked.where(F.col("before") < even_count).select("vertex", "shard", F.col("before").alias("slot"))
    held = {r["shard"]: r["n"] for r in stay.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    surplus = ranked.where(F.col("before") >= even_count).select("vertex", "key")
    unlinked = vertices.join(labels.select("vertex"), "vertex", "left_anti").select("vertex", "key")
    pool = running_sums(
        unlinked.unionByName(surplus).withColumn("one", F.lit(1)), [], "one", "key", ["vertex"], digits=4
    )
    # The pool's first rows go to shard 0, the next to shard 1, as many as each has left.
    shard, slot, start = F.lit(0), F.col("before") + held.get(0, 0), 0
    for s in range(1, shards):
        start += even[s - 1] - held.get(s - 1, 0)
        shard = F.when(F.col("before") >= start, s).otherwise(shard)
        slot = F.when(F.col("before") >= start, F.col("before") - start + held.get(s, 0)).otherwise(slot)
    return stay.unionByName(pool.select("vertex", shard.alias("shard"), slot.cast("long").alias("slot")))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Shards of even row counts for ``docs``, with equal texts together where counts allow.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32, law ('rows'),
    shard, slot (gapless from 0 in each shard), grown_shard (null: only a law by key has it). A
    null text is empty. Repeated rows are rows of their own, a null doc_id is an id like others.
    An empty table gives no rows. A group of equal texts that exceeds a shard is cut.
    """
    text = text_or_empty()
    rows = durable(
        docs.select(
            "doc_id",
            F.monotonically_increasing_id().alias("vertex"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("link"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
        )
    )
    shared = rows.groupBy("link").agg(F.count("*").alias("n")).where("n > 1").select("link")
    members = durable(_salted(rows.select("vertex", "link", "key"), shared).select("vertex", "link", "key"))
    placed = even_shards(rows.select("vertex", "key"), members, shards, rounds)
    return rows.join(placed, "vertex").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
