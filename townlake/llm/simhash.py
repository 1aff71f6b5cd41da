"""SimHash near-duplicates by a Gray-order hierarchical index.

Two fingerprints that differ in at most ``limit`` of 64 bits agree on at least two of limit + 2
blocks of bits, so the pairs of blocks are the roots of the index: a root's pattern is what its
members share on two blocks. Members of a pattern are sorted by Gray rank, which puts fingerprints
with equal bits beside each other, and grouped by sixteens, level upon level. A node keeps the bits
that all below it share, without those its parent has; a search adds up the differences on the
way down and drops a node, with all below it, once they exceed the limit or once all below it is
already linked to the searching fingerprint.

A pattern with more than BLOCK members is cut into blocks in Gray order. Each block's bits in common
are a node above all others: only pairs of blocks whose nodes differ in at most ``limit`` bits are
searched, and a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townlake.llm.common import durable
from townlake.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
BITS = 64
LIMIT = 4
#: Fingerprints under one node.
FAN_OUT = 16
#: Members of a pattern from which on it is cut into blocks.
BLOCK = 50_000
#: Nodes held in memory at once.
AT_ONCE = 1 << 18


def shingle_hashes(text: str, shingle_words: int) -> np.ndarray:
    """A hash of each run of words, repeats included; fewer words make one run, no words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle_words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], "<u8")
    runs = zip(*(words[i:] for i in range(shingle_words)))  # noqa: B905  the shortest ends it
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, runs)], "<u8")


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the shingles' hashes; 0 for a text without words."""
    return of_hashes(shingle_hashes(text, shingle_words))


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of shingles' hashes."""
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[a : a + (1 << 15)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``; fp is the fingerprint as a signed number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", shingle_words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(hashed, narrow.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in the Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def root_masks(limit: int = LIMIT) -> list[int]:
    """Masks of the pairs of limit + 2 blocks, as signed numbers."""
    cuts = [round(k * BITS / (limit + 2)) for k in range(limit + 3)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in combinations(blocks, 2))]


class Links:
    """Which fingerprints of a group are known to be linked: the smallest linked place of each."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            apart = low != high
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(label, high, low)
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label[:] = jumped


class GrayForest:
    """A hierarchy over each group of fingerprints; ``fps`` has whole groups, each in Gray order.

    Level 0 holds the fingerprints themselves, a node of level k up to FAN_OUT nodes of level
    k - 1 of its group; each group ends in one node. ``visits`` counts the nodes searched.
    """

    def __init__(self, starts: np.ndarray, fps: np.ndarray) -> None:
        sizes = np.diff(np.r_[starts, len(fps)])
        self.fps, self.sizes, self.visits = fps, sizes, 0
        self.group = np.repeat(np.arange(len(sizes)), sizes)
        self.height = np.zeros(len(sizes), np.int64)
        self.first, self.begin, self.patterns = [starts], [np.arange(len(fps))], [fps]
        self.ends = [np.arange(1, len(fps) + 1)]
        ones, zeros, masks, counts = fps, ~fps, [np.full(len(fps), ~np.uint64(0))], sizes
        while (counts > 1).any():
            more = np.flatnonzero(counts > 1)
            self.height[more] += 1
            above = np.zeros(len(sizes), np.int64)
            above[more] = -(-counts[more] // FAN_OUT)
            first = np.cumsum(above) - above
            owner = np.repeat(np.arange(len(sizes)), above)
            begin = self.first[-1][owner] + (np.arange(len(owner)) - first[owner]) * FAN_OUT
            end = np.minimum(begin + FAN_OUT, (self.first[-1] + counts)[owner])
            cuts = np.stack([begin, end], 1).ravel()
            cuts = cuts[:-1] if cuts[-1] == len(ones) else cuts
            every = slice(0, None, 2)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts)[every], np.bitwise_and.reduceat(zeros, cuts)[every]
            parent = np.full(len(masks[-1]), -1)
            spans = end - begin
            parent[np.repeat(begin - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))] = np.repeat(np.arange(len(owner)), spans)
            mask = ones | zeros
            masks[-1] = masks[-1] & np.where(parent >= 0, ~mask[parent], ~np.uint64(0))
            masks.append(mask)
            self.first.append(first)
            self.begin.append(begin)
            self.patterns.append(ones)
            self.ends.append(end)
            counts = above
        self.masks = masks

    def _uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each node the label that all below it have, or -1."""
        low = high = label
        out = [label]
        for begin, end in zip(self.begin[1:], self.ends[1:], strict=True):
            cuts = np.stack([begin, end], 1).ravel()
            cuts = cuts[:-1] if cuts[-1] == len(low) else cuts
            low, high = np.minimum.reduceat(low, cuts)[::2], np.maximum.reduceat(high, cuts)[::2]
            out.append(np.where(low == high, low, -1))
        return out

    def chunks(self, searchers: np.ndarray) -> Iterator[np.ndarray]:
        """Searching places in runs that reach at most about AT_ONCE others; the first runs are short."""
        reach = np.cumsum(self.sizes[self.group[searchers]])
        at, most = 0, min(AT_ONCE, 1 << 14)
        while at < len(searchers):
            to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + most, "right")))
            yield searchers[at:to]
            at, most = to, min(AT_ONCE, 4 * most)

    def search(self, searchers: np.ndarray, label: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a searching place and one of its group within ``limit`` bits that has another label."""
        height = self.height[self.group[searchers]]
        who, node, differ = (np.zeros(0, np.int64) for _ in range(3))
        uniform = self._uniform(label)
        for level in range(len(self.patterns) - 1, -1, -1):
            begun = searchers[height == level] if level else searchers[:0]
            who, node = np.r_[who, begun], np.r_[node, self.first[level][self.group[begun]]]
            differ = np.r_[differ, np.zeros(len(begun), np.int64)]
            open_ = uniform[level][node] != label[who]
            who, node, differ = who[open_], node[open_], differ[open_]
            self.visits += len(who)
            differ = differ + np.bitwise_count((self.fps[who] ^ self.patterns[level][node]) & self.masks[level][node])
            near = differ <= limit
            who, node, differ = who[near], node[near], differ[near]
            if level:
                begin, times = self.begin[level][node], (self.ends[level] - self.begin[level])[node]
                who, differ = np.repeat(who, times), np.repeat(differ, times)
                node = np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        return who, node


def starts_of(key: np.ndarray) -> np.ndarray:
    """Where runs of equal ``key`` start."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def linked_within(key: np.ndarray, fps: np.ndarray, searching: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join what is linked within each group; groups are runs of equal ``key``.

    At most one pair a fingerprint: it and the first of those it is linked to.
    """
    forest, links = GrayForest(starts_of(key), fps), Links(len(fps))
    for some in forest.chunks(np.flatnonzero(searching)):
        links.add(*forest.search(some, links.label, limit))
    moved = np.flatnonzero(links.label != np.arange(len(fps)))
    return fps[moved], fps[links.label[moved]]


#: The columns that name a group of the index, and their types.
GROUP = np.dtype([("root", "<i4"), ("pattern", "<i8"), ("one", "<i8"), ("other", "<i8")])


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The keys and the other columns of sorted rows (GROUP, ...), whole groups at a time."""
    held: list[tuple[np.ndarray, list[np.ndarray]]] = []
    joined = lambda: (np.concatenate([k for k, _ in held]), [np.concatenate(c) for c in zip(*(c for _, c in held), strict=True)])
    for batch in batches:
        if not len(batch):
            continue
        key = np.empty(len(batch), GROUP)
        for k, name in enumerate(GROUP.names):
            key[name] = batch.column(k).to_numpy(zero_copy_only=False)
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[len(GROUP.names) :]]
        others = np.flatnonzero(key != key[-1])
        last = int(others[-1]) + 1 if len(others) else 0
        if held and (last or held[-1][0][-1] != key[0]):
            if last:
                held.append((key[:last], [c[:last] for c in columns]))
            yield joined()
            held = []
        elif last:
            yield key[:last], [c[:last] for c in columns]
        held.append((key[last:], [c[last:] for c in columns]))
    if held:
        yield joined()


def in_groups(members: DataFrame, limit: int) -> DataFrame:
    """``members`` (root, pattern, fp, ...) by groups to be searched, without those that are alone.

    Adds the rest of GROUP and ``searching``. Rows are dealt by group and sorted by Gray rank.
    """
    own = [c for c in members.columns if c not in ("root", "pattern")]
    counted = durable(members.groupBy("root", "pattern").agg(F.count("*").alias("n")).where("n > 1"))
    zero = F.lit(0).cast("long")
    placed = (
        members.join(counted.where(F.col("n") <= BLOCK), ["root", "pattern"])
        .select("root", "pattern", zero.alias("one"), zero.alias("other"), *own, F.lit(True).alias("searching"))
    )
    large = counted.where(F.col("n") > BLOCK)
    total = large.agg(F.sum("n")).first()[0]
    if total:
        rank = gray_rank(F.col("fp"))
        ranged = members.join(large.select("root", "pattern"), ["root", "pattern"]).repartitionByRange(-(-total // BLOCK), "root", "pattern", rank)
        blocks = durable(ranged.withColumn("block", F.spark_partition_id().cast("long")))
        nodes = durable(blocks.groupBy("root", "pattern", "block").agg(F.bit_and("fp").alias("ones"), F.bit_and(F.bitwise_not("fp")).alias("zeros")))
        pairs = (
            nodes.alias("a").join(nodes.alias("b"), ["root", "pattern"])
            .where(F.expr(f"a.block <= b.block and bit_count((a.ones & b.zeros) | (a.zeros & b.ones)) <= {limit}"))
            .select("root", "pattern", F.col("a.block").alias("one"), F.col("b.block").alias("other"))
        )
        both = pairs.withColumn("block", F.explode(F.array_distinct(F.array("one", "other"))))
        placed = placed.unionByName(
            blocks.join(both, ["root", "pattern", "block"])
            .select("root", "pattern", "one", "other", *own, (F.col("block") == F.col("one")).alias("searching"))
        )
    return placed.repartition(*GROUP.names).sortWithinPartitions(*GROUP.names, gray_rank(F.col("fp")))


def near_links(fingerprints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges (u, v) that connect all distinct ``fp`` within ``limit`` bits of each other."""
    masks = F.array(*[F.struct(F.lit(k).alias("root"), F.lit(m).cast("long").alias("mask")) for k, m in enumerate(root_masks(limit))])
    members = (
        fingerprints.select("fp", F.explode(masks).alias("m"))
        .select(F.col("m.root").alias("root"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("pattern"), "fp")
    )

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (fp, searching) in whole_groups(batches):
            u, v = linked_within(key, fp.astype(np.int64).view(np.uint64), searching.astype(bool), limit)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return in_groups(members, limit).mapInArrow(linked, "u long, v long")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint and component_id for every row of ``docs``.

    The fingerprint has 16 hexadecimal digits. Rows whose fingerprints differ in at most ``limit``
    bits are linked, texts without words (fingerprint zero, as null texts) like any other;
    component_id is the smallest doc_id that links reach. Null ids are never that smallest id,
    a component with no other id has none. Repeated rows are linked; an empty table gives no rows.
    """
    hashed = durable(with_fingerprints(docs, shingle_words))
    classes = durable(hashed.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    linked = durable(components(near_links(classes.select("fp"), limit)))
    by_root = (
        classes.join(linked, classes["fp"] == linked["node"])
        .groupBy("root").agg(F.min("least_id").alias("component_id"))
    )
    of_linked = linked.join(by_root, "root").select(F.col("node").alias("fp"), F.col("component_id").alias("linked_id"))
    # Stored, so that Spark may split the rows of a common fingerprint over tasks.
    known = durable(classes.join(of_linked, "fp", "left").select("fp", F.coalesce("linked_id", "least_id").alias("component_id")))
    return hashed.join(known, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
