"""Log probabilities of whole documents by a recurrent language model that all documents train.

Words are counted over the whole corpus. Training documents are dealt to groups by a hash, each
group trains the same initial network on all its documents, and the networks are averaged in a tree
of small groups; groups and their order depend on the documents alone, not on how the table is cut.
The averaged network scores every document from its first word to its end. Frequent words are known
to every task; counts of the others are joined to the documents that use them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from townlake.llm import recurrent
from townlake.llm.common import SPACES, durable, lower_ascii, session, text_or_empty
from townlake.llm.labelled import held_out

#: Words that the network tells apart, with the end of a text; all others go by classes.
FREQUENT = 512
RARE_CLASSES = 48
#: Words, at most, whose counts every task gets, the most frequent, and their bytes. Other words' counts are joined.
SHARED = 150_000
SHARED_BYTES = 1 << 22
RATE = 0.01
#: Training documents of a network, about, and networks that one task averages.
DOCUMENTS = 4096
GROUP = 16
#: Words of the documents that are trained or scored together.
BLOCK_WORDS = 6_000_000
#: Ends of words whose classes a task remembers.
REMEMBERED = 100_000


def rare_class(word: bytes) -> int:
    """A word's class by its last letters, which tell languages apart."""
    return zlib.crc32(word[-3:]) % RARE_CLASSES


def _rare_class_column(word: Column) -> Column:
    raw = F.encode(word, "UTF-8")
    return F.crc32(F.substring(raw, -3, 3)) % RARE_CLASSES


class _Classes(dict):
    """Classes by the last letters of a word."""

    def __missing__(self, end: bytes) -> int:
        found = rare_class(end)
        if len(self) < REMEMBERED:
            self[end] = found
        return found


class Vocabulary:
    """Counts of the shared words and sums over all others; the same few megabytes for any corpus."""

    def __init__(self, shared: list[tuple[bytes, int]], rare: np.ndarray, kinds: np.ndarray, texts: int, total: int, distinct: int):
        self.texts, self.total, self.distinct = texts, total, distinct
        counts = np.array([n for _, n in shared], float)
        self.frequent = [w for w, _ in shared[: FREQUENT - 1]]
        self.layout = recurrent.Layout(len(self.frequent) + 1, RARE_CLASSES)
        self.places = {w: i for i, (w, _) in enumerate(shared)}
        self.class_of = np.array([rare_class(w) for w, _ in shared], np.int64)
        self.ids = (self.class_of + len(self.frequent) + 1).astype(np.int32)
        self.ids[: len(self.frequent)] = np.arange(len(self.frequent)) + 1
        # ``rare`` and ``kinds`` are over all words; the frequent ones are taken out.
        k = len(self.frequent)
        rare = rare - np.bincount(self.class_of[:k], counts[:k], RARE_CLASSES)
        kinds = kinds - np.bincount(self.class_of[:k], minlength=RARE_CLASSES)
        self.class_norm = np.log10(rare + 0.5 * (kinds + 1))
        self.counts = np.concatenate([[texts], counts[:k], rare]).astype(float)
        self.norm = float(np.log10(total + 0.5 * (distinct + 1)))
        self.logs = np.log10(counts + 0.5)
        # What a shared word adds to the network's score: nothing if the network knows the word.
        self.inside = self.logs - self.class_norm[self.class_of]
        self.inside[:k] = 0


def _raw(texts: pa.Array) -> list[bytes]:
    """Texts as bytes; null as empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_numpy(zero_copy_only=False)]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all training documents."""
    text = lower_ascii(text_or_empty())
    for space in SPACES[1:]:
        text = F.replace(text, F.lit(space), F.lit(" "))
    words = docs.where(~held_out(5, 1)).select(F.explode(F.split(text, " ")).alias("word"))
    return words.where("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(docs: DataFrame, counts: DataFrame) -> Vocabulary:
    texts = docs.where(~held_out(5, 1)).count()
    rare, kinds = np.zeros(RARE_CLASSES), np.zeros(RARE_CLASSES)
    for r in counts.groupBy(_rare_class_column(F.col("word")).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        rare[r["c"]], kinds[r["c"]] = r["n"], r["k"]
    # Words by steps of their count; as many whole steps as SHARED and SHARED_BYTES allow.
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    stepped = counts.select("word", "n", step)
    least, held, size = 1 << 30, 0, 0
    for r in stepped.groupBy("step").agg(F.count("*").alias("k"), F.sum(F.octet_length("word")).alias("bytes")).orderBy(F.desc("step")).collect():
        held, size = held + r["k"], size + r["bytes"]
        if held > SHARED or size > SHARED_BYTES:
            break
        least = r["step"]
    top = stepped.where(F.col("step") >= least).select("word", "n").toPandas()
    shared = sorted(((w.encode("utf-8", "surrogatepass"), int(n)) for w, n in zip(top["word"], top["n"], strict=True)), key=lambda x: (-x[1], x[0]))
    return Vocabulary(shared, rare, kinds, texts, int(rare.sum()) + texts, int(kinds.sum()) + (texts > 0))


def _numbered(text: bytes, vocab: Vocabulary, classes: _Classes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The ids of a text's words, the words that are not shared, and the places of those that are."""
    split = text.lower().split()
    places = np.fromiter(map(vocab.places.get, split, repeat(-1)), np.int64, len(split))
    rare = np.flatnonzero(places < 0)
    if not len(vocab.ids) and len(rare):
        places, ids = places[:0], np.zeros(len(split), np.int32)
    else:
        ids = vocab.ids[places]
    others = [split[k] for k in rare.tolist()]
    ids[rare] = [classes[w[-3:]] + len(vocab.frequent) + 1 for w in others]
    return ids, others, places[places >= 0]


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int, vocab: Vocabulary, each: Callable):
    """Rows and the word ids of their texts, about BLOCK_WORDS at a time.

    Only ids are kept of a text; ``each`` sees what else there is of its words as they come by.
    """
    classes = _Classes()
    for batch in batches:
        first, held, found = 0, 0, []
        for i, text in enumerate(_raw(batch.column(text_at))):
            ids, others, places = _numbered(text, vocab, classes)
            each(len(found), ids, others, places)
            found.append(ids)
            held += len(ids)
            if held >= BLOCK_WORDS:
                yield batch.slice(first, i + 1 - first), found
                first, held, found = i + 1, 0, []
        if found:
            yield batch.slice(first), found


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One network a group, weighted by the words it was trained on; rows come sorted by group."""
    group, total, weight = None, None, 0
    names = ["part", "words", "network"]

    def row() -> pa.RecordBatch:
        raw = (total / max(weight, 1)).astype("<f4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([weight], pa.int64()), pa.array([raw], pa.binary())], names)

    for batch in batches:
        for g, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            values = np.frombuffer(raw, "<f4").astype(np.float64) * n
            if g != group:
                if group is not None:
                    yield row()
                group, total, weight = g, values, n
            else:
                total, weight = total + values, weight + n
    if group is not None:
        yield row()


def train(docs: DataFrame, vocab: Vocabulary) -> recurrent.Weights:
    """The network that all training documents have trained."""
    shared = session(docs).sparkContext.broadcast(vocab)
    start = recurrent.initial(vocab.layout, vocab.counts)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, group, trainer, n = shared.value, None, None, 0
        classes, held, size = _Classes(), [], 0

        def row() -> pa.RecordBatch:
            if held:
                trainer.learn(held, 0)
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([n], pa.int64()), pa.array([recurrent.packed(trainer.p)], pa.binary())], ["part", "words", "network"])

        for batch in batches:
            for g, text in zip(batch.column(0).to_pylist(), _raw(batch.column(1)), strict=True):
                if g != group:
                    if group is not None:
                        yield row()
                    group, trainer, n, held, size = g, recurrent.Trainer(start, v.layout, RATE), 0, [], 0
                held.append(_numbered(text, v, classes)[0])
                n, size = n + len(held[-1]) + 1, size + len(held[-1])
                if size >= BLOCK_WORDS:
                    trainer.learn(held, 0)
                    held, size = [], 0
        if group is not None:
            yield row()

    schema = "part long, words long, network binary"
    # Rows that have all in common are interchangeable, so any order of them gives the same network.
    order = F.xxhash64("doc_id", "text")
    left = -(-vocab.texts // DOCUMENTS)
    texts = docs.where(~held_out(5, 1)).select(F.pmod(order, F.lit(max(1, left))).alias("part"), order.alias("order"), "doc_id", "text")
    networks = texts.repartition("part").sortWithinPartitions("part", "order", "doc_id", "text").select("part", "text").mapInArrow(learn, schema)
    while left > 1:
        left = -(-left // GROUP)
        grouped = networks.withColumn("from", F.col("part")).withColumn("part", F.expr(f"part div {GROUP}"))
        networks = grouped.repartition("part").sortWithinPartitions("part", "from").drop("from").mapInArrow(_averaged, schema)
    rows = networks.collect()  # one row
    return recurrent.unpacked(rows[0]["network"], start) if rows else start


def _scored(docs: DataFrame, vocab: Vocabulary, network: recurrent.Weights) -> DataFrame:
    """A row a document, and a row for each of its words that is not shared.

    ``row`` names the document. Of a document: its sums over shared words. Of a word: ``word``.
    """
    context = session(docs).sparkContext
    shared, model = context.broadcast(vocab), context.broadcast(network)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(5, 1).alias("held_out"), "text")
    schema = T.StructType()
    for field in numbered.drop("text").schema:
        schema = schema.add(field.name, field.dataType)
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("score", "double"), ("word", "binary")):
        schema = schema.add(name, kind)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        end_log = float(np.log10(v.texts + 0.5))
        out: list[list] = [[] for _ in range(4)]
        rare: list[list] = [[], []]
        first = len(v.frequent) + 1

        def sums(i: int, ids: np.ndarray, rare_words: list[bytes], places: np.ndarray) -> None:
            rare[0].extend(repeat(i, len(rare_words)))
            rare[1].extend(rare_words)
            known = len(places) + int(v.texts > 0)
            # Of a rare word the network gives the class; what its count adds inside is joined later.
            by_class = np.bincount(ids[ids >= first] - first, minlength=RARE_CLASSES)
            shared_too = np.bincount(v.class_of[places[places >= len(v.frequent)]], minlength=RARE_CLASSES)
            inside = float(v.inside[places].sum() - (by_class - shared_too) @ v.class_norm)
            for column, x in zip(out, (len(ids) + 1, known, end_log + float(v.logs[places].sum()), inside), strict=True):
                column.append(x)

        for batch, texts in _blocks(batches, 3, v, sums):
            model_logs = recurrent.score(model.value, v.layout, texts, 0) / np.log(10) + np.array(out[3])
            empty = pa.nulls(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.float64()), pa.array(model_logs), empty.cast(pa.binary())],
                schema.names,
            )
            if rare[0]:
                at = pa.array(rare[0])
                n = pa.nulls(len(at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), n.cast(batch.column(1).type), n.cast(pa.bool_()), n.cast(pa.int64()), n.cast(pa.int64()),
                     n.cast(pa.float64()), n.cast(pa.float64()), pa.array(rare[1], pa.binary())],
                    schema.names,
                )
            for column in (*out, *rare):
                column.clear()

    return numbered.mapInArrow(score, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Training rows are those whose crc32 of the id is not 1 modulo 5; a row with a null id is held
    out. A null text is empty; every text ends with an end token, so an empty one has one token.
    Repeated rows score alike, up to rounding, and so does any other cut of the table. Without training rows all words are unknown and the network is
    untrained; an empty table gives no rows.
    """
    narrow = docs.select("doc_id", "text")
    counts = durable(count_words(narrow))
    vocab = vocabulary(narrow, counts)
    rows = durable(_scored(narrow, vocab, train(narrow, vocab)))
    rare = (
        rows.where("word is not null")
        .select("row", F.col("word").cast("string").alias("word"))
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), F.count("n").alias("known"))
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return (
        rows.where("word is null")
        .join(rare, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(vocab.total).cast("long").alias("train_tokens"),
            (F.col("base") + logs - F.col("n_tokens") * vocab.norm).alias("base_score"),
            (F.col("score") + logs).alias("score"),
        )
    )
