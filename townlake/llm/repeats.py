"""Removing byte strings that occur more than once in the corpus.

A suffix array of the whole corpus would have a row for every byte. Most bytes are in no repeated
string, and anchors tell which may be: of all ``ANCHOR``-byte strings inside a window of ``least``
bytes, the one with the smallest hash. Equal windows choose the same anchor at the same place, so
windows can only be equal if their anchors are. Around every anchor that occurs more than once,
all that its windows hold is a span. Spans that are equal as a whole (by a 128-bit digest of their
bytes) are settled as they are. One of each other kind goes, with all others of its anchor, into a
Burrows-Wheeler transform of some megabytes, whose intervals are expanded breadth first, common
prefixes by increasing value, up to ``least`` (see ``transform``): that compares bytes, not hashes.

Anchors with more spans than a transform holds are narrowed first: spans are cut into runs of 64,
16, 4 and 1 windows, and a run only meets runs that have the same bytes where all its windows
overlap. Equal runs are settled, so one string that all documents share is a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townlake.llm.common import durable, session, stored, text_or_empty
from townlake.llm.transform import MOST_STRINGS, repeated_windows

LEAST = 400
ANCHOR = 128
#: Bytes of spans in one transform.
BLOCK = 1 << 21
#: Windows in a run, round by round, for anchors with more bytes of spans than BLOCK.
WIDTHS = (64, 16, 4, 1)
#: Bytes that are hashed at once, of several documents or of a part of one; parts overlap.
PART = 1 << 19
#: Bits of the filter of repeated anchors for each of them, and in all (32 MB at most).
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of polynomial hashes, whose low bits are weak."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SubstringHash:
    """Hashes of any substrings of a byte string from sums of its prefixes, modulo 2**64."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.of_byte = rng.integers(1, 1 << 63, 256, np.uint64)
        base = int(rng.integers(1, 1 << 62)) * 4 + 1
        n = 2 * PART + 8 * LEAST
        self.up, self.down = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.up[: len(data)], out=out[1:], dtype=np.uint64)
        return out

    def __call__(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (np.asarray(end) - start).astype(np.uint64)
        return _mixed((sums[end] - sums[start]) * self.down[start] + length * np.uint64(0x9E3779B97F4A7C15))


_hash: list[SubstringHash] = []


def _of_substrings() -> SubstringHash:
    """The hash function of anchors; its tables are made once a worker."""
    if not _hash:
        _hash.append(SubstringHash(6))
    return _hash[0]


def chosen_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` neighbouring values the place of the first smallest."""
    best = (values & np.uint64(_MASK << 21 & _MASK)) | np.arange(len(values), dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < width:
        best = np.minimum(best[: len(best) - (width - reach)], best[width - reach :])
    return (best & np.uint64((1 << 21) - 1)).astype(np.int64)


class Anchors(NamedTuple):
    """Anchors of some texts: whose, where, their hash, and the windows that chose them.

    Windows that begin ``low`` to ``high`` bytes before the anchor chose it.
    """

    owner: np.ndarray
    place: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _chunk_anchors(parts: list[tuple[int, int, np.ndarray]], least: int) -> Anchors:
    """Anchors of parts (owner, offset in its text, bytes), hashed as one string."""
    one = _of_substrings()
    data = np.concatenate([p for _, _, p in parts])
    begin = np.cumsum([0] + [len(p) for _, _, p in parts])
    sums = one.sums(data)
    starts = np.arange(len(data) - ANCHOR + 1)
    values = one(sums, starts, starts + ANCHOR)
    chosen = chosen_places(values, least - ANCHOR + 1)
    change = np.zeros(len(chosen) + 1, np.int64)
    np.add.at(change, begin[:-1], 1)
    np.add.at(change, begin[1:] - least + 1, -1)
    window = np.flatnonzero(np.cumsum(change[:-1]) > 0)  # those that lie in one text
    place = chosen[window]
    turns = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    first, last = window[turns], window[np.r_[turns[1:], len(window)] - 1]
    place = place[turns]
    part = np.searchsorted(begin, first, "right") - 1
    owner, base = np.array([o for o, _, _ in parts]), np.array([at for _, at, _ in parts])
    return Anchors(owner[part], place - begin[part] + base[part], values[place], place - last, place - first)


def anchors(texts: Iterable[np.ndarray], least: int = LEAST) -> Iterator[Anchors]:
    """Anchors of texts, which are numbered as they come."""
    parts: list[tuple[int, int, np.ndarray]] = []
    held = 0
    for owner, data in enumerate(texts):
        for at in range(0, len(data) - least + 1, PART):
            parts.append((owner, at, data[at : at + PART + least - 1]))
            held += len(parts[-1][2])
            if held >= PART:
                yield _chunk_anchors(parts, least)
                parts, held = [], 0
    if parts:
        yield _chunk_anchors(parts, least)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _each_batch(work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)

    return run


class _Filter:
    """Which anchors may be repeated: bits by hash. It lets through some more, never fewer."""

    def __init__(self, bits: int, rows: list) -> None:
        self.bits = bits
        self.words = np.zeros(bits // 8, np.uint8)
        for r in rows:
            part = np.frombuffer(r["bits"], np.uint8)
            at = (r["bucket"] - 1) * 4096
            self.words[at : at + len(part)] = part

    def may_hold(self, anchor: np.ndarray) -> np.ndarray:
        bit = (anchor & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.words[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _repeated_anchors(texts: DataFrame, least: int) -> _Filter:
    """A filter of the anchors that occur more than once, of a size that is bounded."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for found in anchors((_bytes(t.as_py()) for t in batch.column(0)), least):
            yield pa.RecordBatch.from_arrays([_signed(found.anchor)], ["anchor"])

    counts = texts.select("text").mapInArrow(_each_batch(work), "anchor long").groupBy("anchor").agg(F.count("*").alias("n"))
    often = durable(counts.where("n > 1").select("anchor"))
    bits = 1 << 15
    while bits < min(MOST_FILTER_BITS, FILTER_BITS * often.count()):
        bits *= 2
    bit = F.col("anchor").bitwiseAND(F.lit(bits - 1).cast("long"))
    rows = (
        often.select((bit + 1).alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    )
    return _Filter(bits, rows.collect())


def _digest(raw: bytes | memoryview) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _anchor_rows(texts: DataFrame, known: Broadcast, least: int) -> DataFrame:
    """(anchor, low, high, span, digest, place) of the anchors that the filter lets through.

    ``span`` is the digest of all bytes that the anchor's windows hold, ``digest`` that of the text.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = [_bytes(t.as_py()) for t in batch.column(1)]
        for found in anchors(raw, least):
            kept = known.value.may_hold(found.anchor)
            if kept.any():
                owner, place, anchor, low, high = (x[kept] for x in found)
                spans = zip(owner.tolist(), (place - high).tolist(), (place - low + least).tolist(), strict=True)
                span = [_digest(raw[o][a:b]) for o, a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [_signed(anchor), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(span),
                     batch.column(0).take(pa.array(owner)), pa.array(place)],
                    ["anchor", "low", "high", "span", "digest", "place"],
                )

    return texts.mapInArrow(_each_batch(work), "anchor long, low int, high int, span binary, digest binary, place long")


def _distinct_texts(texts: DataFrame) -> DataFrame:
    return texts.groupBy("digest").agg(F.first("text").alias("text"))


CONTEXT = "class long, digest binary, place long, low int, high int, open boolean, context binary"
_CONTEXT_NAMES = [c.split()[0] for c in CONTEXT.split(", ")]
_CONTEXT_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]


def _rows_out(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_CONTEXT_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _CONTEXT_TYPES, strict=True)], _CONTEXT_NAMES)


def _contexts(asked: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """The bytes of spans: ``context``, which begins ``high`` before the anchor of its class."""
    lists = asked.groupBy("digest").agg(F.collect_list(F.struct("anchor", "place", "low", "high", "open")).alias("asked"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for digest, text, wanted in zip(*batch.columns, strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            yield _rows_out([
                (w["anchor"], digest.as_py(), w["place"], w["low"], w["high"], w["open"], raw[w["place"] - w["high"] : w["place"] + least - w["low"]])
                for w in wanted.as_py()
            ])

    return _distinct_texts(texts).join(lists, "digest").select("digest", "text", "asked").mapInArrow(_each_batch(work), CONTEXT)


def _narrowed(contexts: DataFrame, width: int, least: int) -> DataFrame:
    """Contexts cut into runs of ``width`` windows, of a class for each string that a run must hold."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for cls, digest, place, low, high, open_, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k in range(low // width, high // width + 1):
                common = context[high - k * width : high - (k * width + width - 1) + least]
                name = hashlib.blake2b(b"%d %d " % (cls, k) + common, digest_size=8).digest()
                a, b = max(low, k * width), min(high, k * width + width - 1)
                rows.append((int.from_bytes(name, "little", signed=True), digest, place, a, b, open_, context[high - b : high - a + least]))
        yield _rows_out(rows)

    return contexts.mapInArrow(_each_batch(work), CONTEXT)


def _transformed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(digest, start, end) of what is repeated in contexts sorted by class, some classes at a time."""
    held: list[tuple] = []
    size, last, names = 0, None, ["digest", "start", "end"]

    def found() -> pa.RecordBatch:
        out: list[tuple] = []
        flags = repeated_windows([np.frombuffer(r[6], np.uint8) for r in held], least)
        for (_, digest, place, _, high, open_, _), flag in zip(held, flags, strict=True):
            if open_ and flag.any():
                turns = np.flatnonzero(np.diff(np.r_[False, flag, False].astype(np.int8))).reshape(-1, 2) + (place - high)
                out += [(digest, int(a), int(b) + least - 1) for a, b in turns]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)], names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != last and (size >= BLOCK or 2 * len(held) >= MOST_STRINGS):
                yield found()
                held, size = [], 0
            last = row[0]
            held.append(row)
            size += len(row[6])
    if held:
        yield found()


def repeated_in_classes(contexts: DataFrame, least: int) -> DataFrame:
    """(digest, start, end): windows of open contexts that another context of their class has."""
    spans, small = [], []
    for width in WIDTHS:
        sizes = contexts.groupBy("class").agg(F.sum(F.octet_length("context")).alias("bytes"))
        large = durable(sizes.where(F.col("bytes") > BLOCK).select("class"))
        if large.isEmpty():
            break
        small.append(contexts.join(large, "class", "left_anti"))
        runs = stored(_narrowed(contexts.join(large, "class", "left_semi"), width, least), "runs")
        key = ["class", "low", "high", "span"]
        named = runs.withColumn("span", F.unhex(F.sha2("context", 256)))
        kinds = stored(named.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("digest", "place", "open", "context")).alias("one")), "kinds")
        spans.append(
            named.where("open")
            .join(kinds.where("n > 1").select(*key), key, "left_semi")
            .select("digest", (F.col("place") - F.col("high")).alias("start"), (F.col("place") + least - F.col("low")).alias("end"))
        )
        still = F.col("one.open") & (F.col("n") == 1)
        several = kinds.groupBy("class").agg(F.count("*").alias("kinds"), F.max(still).alias("any")).where("kinds > 1 and any")
        contexts = stored(
            kinds.join(several.select("class"), "class", "left_semi")
            .select("class", "one.digest", "one.place", "low", "high", still.alias("open"), "one.context"),
            "narrowed",
        )
    for part in [*small, contexts]:
        dealt = part.repartition("class").sortWithinPartitions("class")
        spans.append(dealt.mapInArrow(lambda batches: _transformed(batches, least), "digest binary, start long, end long"))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def repeated_spans(texts: DataFrame, known: Broadcast, least: int = LEAST) -> DataFrame:
    """(digest, start, end): spans of texts that strings of ``least`` bytes found elsewhere cover.

    ``texts`` has (digest, text); spans may overlap. Their union holds every covered byte.
    """
    kept = stored(_anchor_rows(texts, known, least), "anchors")
    key = ["anchor", "low", "high", "span"]
    spans = stored(kept.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("digest", "place")).alias("one")), "spans")
    shared = (
        kept.join(spans.where("n > 1").select(*key), key, "left_semi")
        .select("digest", (F.col("place") - F.col("high")).alias("start"), (F.col("place") + least - F.col("low")).alias("end"))
        .distinct()
    )
    several = spans.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least_n")).where("least_n = 1 and kinds > 1")
    asked = spans.join(several.select("anchor"), "anchor", "left_semi").select("anchor", "low", "high", "one.*", (F.col("n") == 1).alias("open"))
    contexts = stored(_contexts(asked, texts, least), "contexts")
    return shared.unionByName(repeated_in_classes(contexts, least))


def _without(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """(digest, n_removed, n_spans, kept_sha256) of the texts that have spans."""
    lists = spans.groupBy("digest").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        removed, runs, kept_hash = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            fields = spans.values.flatten()
            change = np.zeros(len(raw) + 1, np.int64)
            np.add.at(change, np.clip(np.asarray(fields[0]), 0, len(raw)), 1)
            np.add.at(change, np.clip(np.asarray(fields[1]), 0, len(raw)), -1)
            gone = np.cumsum(change[:-1]) > 0
            removed.append(int(gone.sum()))
            runs.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            kept_hash.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept_hash, pa.string())],
            ["digest", "n_removed", "n_spans", "kept_sha256"],
        )

    schema = "digest binary, n_removed long, n_spans long, kept_sha256 string"
    return _distinct_texts(texts).join(lists, "digest").select("digest", "text", "spans").mapInArrow(_each_batch(work), schema)


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    A byte is removed if a string of ``least`` bytes that holds it also starts elsewhere, in
    another row or in the same text, where strings may overlap. A null text is empty, a shorter
    one than ``least`` stays whole, repeated rows repeat each other. An empty table gives no rows.
    """
    text = text_or_empty()
    keyed = docs.select("doc_id", F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("digest"), text.alias("text"))
    texts = keyed.select("digest", "text").where(F.octet_length("text") >= least)
    known = session(docs).sparkContext.broadcast(_repeated_anchors(texts, least))
    changed = _without(repeated_spans(texts, known, least), texts)
    return (
        keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
        .join(changed, "digest", "left")
        .select(
            "doc_id",
            "n_bytes",
            F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
            F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
            F.coalesce("kept_sha256", "own").alias("kept_sha256"),
        )
    )
