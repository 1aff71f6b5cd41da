"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

A text's features are the shares of the character n-grams of its lower-cased words, with a sign
before and after each word, in hashed buckets, times the rarity of the bucket among all documents
that may be learned from. One task learns from a bounded sample that comes to it in order, pass
after pass, by follow-the-regularised-leader: each weight of each class keeps its own sums, an L1
penalty leaves weights at zero until their gradients outweigh it, an L2 penalty keeps the others
small. What it has not learned from then gives the temperature that the scores are divided by.

Shares add up over words, so a text's scores are the sums of its words' scores, and a worker
remembers those. Nothing but the text goes into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townlake.llm.common import session, stored
from townlake.llm.labelled import held_out

#: What a text is called that is null or has no letter.
NO_LANGUAGE = "und"
#: The longest n-gram, and the bits of a bucket's number.
LONGEST_GRAM, BUCKET_BITS = 4, 18
BUCKETS = 1 << BUCKET_BITS
#: Documents in the sample that the classifier is fitted on, about: equal numbers of each language, those with the smallest hashes of
#: their ids. And how many languages, the most frequent ones, it can tell apart.
SAMPLE, MOST_LANGUAGES = 6000, 200
#: Of so many documents of the sample one is for the temperature.
CALIBRATING = 5
PASSES = 3
#: Features are shares times this, so that an ordinary text's are about one.
SCALE = 100.0
#: Of the learner: step and its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.01
#: Words and their characters that a worker remembers.
REMEMBERED, REMEMBERED_CHARS = 400_000, 8_000_000
#: Texts that are scored together.
BLOCK = 256

_WORD = re.compile(r"[^\W\d_]+")
BEGIN, END = "\x02", "\x03"


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return _WORD.findall(text.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of some words, word by word, and how many each word has."""
    signs = np.frombuffer("".join(f"{BEGIN}{w}{END}" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(signs))
    owner = np.repeat(np.arange(len(words)), sizes)
    hashes, found, owners = np.zeros(len(signs), np.uint64), [], []
    for n in range(1, LONGEST_GRAM + 1):
        hashes = hashes[: len(signs) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + signs[n - 1 :] + np.uint64(n)
        at = np.flatnonzero(left[: len(hashes)] >= n)
        mixed = hashes[at] ^ (hashes[at] >> np.uint64(29))
        found.append((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS))
        owners.append(owner[at])
    buckets, owners = np.concatenate(found).astype(np.int64), np.concatenate(owners)
    return buckets[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))


class WordGrams:
    """The n-grams of words, remembered."""

    def __init__(self) -> None:
        self.known: dict[str, np.ndarray] = {}
        self.chars = 0

    def learn(self, words: Iterable[str]) -> None:
        """Those of all words that some texts have, which are asked for next."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.known, self.chars = {}, 0
        new = list({w for w in words if w not in self.known})
        if new:
            buckets, sizes = grams(new)
            buckets, at = buckets.astype(np.int32), np.r_[0, np.cumsum(sizes)].tolist()
            self.known.update((w, buckets[a:b]) for w, a, b in zip(new, at, at[1:], strict=False))
            self.chars += sum(map(len, new))

    def of(self, counts: Counter) -> list[np.ndarray]:
        return [self.known[w] for w in counts]

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct buckets of a text's n-grams, in order, and how often each occurs."""
        counts = Counter(words_of(text))
        self.learn(counts)
        if not counts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = self.of(counts)
        times = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), [len(p) for p in parts])
        buckets, place = np.unique(np.concatenate(parts).astype(np.int64), return_inverse=True)
        return buckets, np.bincount(place, weights=times, minlength=len(buckets)).astype(np.int64)


def count_documents(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray]:
    """How many texts there are, and in how many of them an n-gram of each bucket occurs."""
    words, n, texts = WordGrams(), np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        texts += len(batch)
        for k in range(0, len(batch), BLOCK):
            found = [set(words_of(t or "")) for t in batch.column(0).slice(k, BLOCK).to_pylist()]
            words.learn(w for own in found for w in own)
            for own in filter(None, found):
                n[np.concatenate(words.of(own))] += 1  # a bucket counts once, however often it is there
    return texts, n


class Learner:
    """Multinomial logistic regression by follow-the-regularised-leader with an elastic net."""

    def __init__(self, classes: int, buckets: int = BUCKETS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))  # the last row is the intercept
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        """One step for one document with the features ``values`` at ``rows``."""
        rows, values = np.r_[rows, len(self.z) - 1], np.r_[values, 1.0]
        w = self.weights(rows)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """What to divide logits by so that the labels are likeliest: between 1/20 and 20, by narrowing; 1 without rows.

    Of n rows the labels count as if one more of each class had been seen: rows without an error do not
    make a classifier certain.
    """
    n, classes = logits.shape
    if not n:
        return 1.0
    wanted = np.full((n, classes), 1 / (n + classes))
    wanted[np.arange(n), labels] += n / (n + classes)
    loss = lambda t: -(wanted * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(1).mean()
    low, high = -np.log(20.0), np.log(20.0)
    for _ in range(60):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    """Names, an array of the weights of each bucket (rarity and scale in them), intercepts and the temperature."""

    names: list[str]
    weights: np.ndarray
    intercepts: np.ndarray
    temperature: float


class Scorer:
    """Languages of texts by a model; a word's sum of weights is remembered."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.sums, self.sizes, self.chars = np.zeros((1024, len(self.model.names)), np.float32), np.zeros(1024, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        start = len(self.place)
        self.place.update(zip(words, range(start, start + len(words)), strict=True))
        while len(self.sizes) < start + len(words):
            self.sums, self.sizes = np.concatenate([self.sums, self.sums]), np.concatenate([self.sizes, self.sizes])
        buckets, sizes = grams(words)
        self.sums[start : start + len(words)] = np.add.reduceat(self.model.weights[buckets], np.cumsum(sizes) - sizes, axis=0)
        self.sizes[start : start + len(words)] = sizes
        self.chars += sum(map(len, words))

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(whether a text has a letter, its class scores)."""
        if len(self.place) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        some, out = np.zeros(len(texts), bool), np.zeros((len(texts), len(self.model.names)))
        found = [Counter(words_of(text)) for text in texts]
        new = list({w for counts in found for w in counts if w not in self.place})
        if new:
            self._learn(new)
        for k, counts in enumerate(found):
            if counts:
                at = np.fromiter(map(self.place.__getitem__, counts), np.int64, len(counts))
                times = np.fromiter(counts.values(), np.float64, len(counts))
                some[k], out[k] = True, times @ self.sums[at] / (times @ self.sizes[at]) + self.model.intercepts
        return some, out

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and how likely it is; NO_LANGUAGE and 0 for a text without letters."""
        names = self.model.names
        if not names:
            return [NO_LANGUAGE] * len(texts), np.zeros(len(texts))
        some, logits = self.logits(texts)
        p = softmax(logits / self.model.temperature)
        best = p.argmax(1)
        return [names[b] if s else NO_LANGUAGE for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, p[np.arange(len(p)), best], 0.0)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(bucket, n): in how many texts of ``docs`` (text) an n-gram of each bucket occurs; bucket -1 has the number of texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, n = count_documents(batches)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, found]), pa.array(np.r_[texts, n[found]])], ["bucket", "n"])

    return docs.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _rarities(docs: DataFrame) -> np.ndarray:
    """The logarithm of how rare each bucket is, as 2**BUCKET_BITS numbers."""
    table = document_frequencies(docs).toArrow()
    bucket, n = (table.column(k).to_numpy() for k in ("bucket", "n"))
    counts = np.zeros(BUCKETS)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    return np.log((1 + n[bucket < 0].sum()) / (1 + counts)).astype(np.float32)


def _sample(learnable: DataFrame, sample: int) -> tuple[list[str], DataFrame]:
    """The languages in order, and (label, order, text) of the documents that are learned from."""
    counts = learnable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    names = sorted(r["lang"] for r in counts)
    share = {r["lang"]: min(1.0, sample / len(counts) / r["n"]) for r in counts}
    chosen = learnable.sparkSession.createDataFrame([(n, k, share[n]) for k, n in enumerate(names)], "lang string, label int, share double")
    order = F.md5(F.col("doc_id").cast("string"))
    drawn = F.conv(F.substring(order, 1, 8), 16, 10).cast("long") / float(1 << 32)
    return names, learnable.join(F.broadcast(chosen), "lang").where(drawn < F.col("share")).select("label", order.alias("order"), "text")


def _features(texts: DataFrame) -> DataFrame:
    """(label, order, buckets, counts) of (label, order, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordGrams()
        for batch in batches:
            found = [words.features(t or "") for t in batch.column(2).to_pylist()]
            columns = [pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["label", "order", "buckets", "counts"])

    return texts.mapInArrow(made, "label int, order string, buckets array<int>, counts array<int>")


def fitted(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """A model of the rows of ``docs`` (doc_id, text, lang) that are not held out and have a language."""
    learnable = docs.where(F.col("lang").isNotNull() & ~held_out(4, 2)).select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    names, texts = _sample(learnable, sample)
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    shared = session(docs).sparkContext.broadcast(_rarities(learnable))
    features = stored(_features(texts), "language-features")
    calibrating = F.pmod(F.crc32("order"), F.lit(CALIBRATING)) == 0
    turns = F.when(calibrating, F.array(F.lit(PASSES))).otherwise(F.sequence(F.lit(0), F.lit(PASSES - 1)))
    # The sample is bounded; the order of its rows, and so the model, does not depend on partitions.
    rows = features.withColumn("turn", F.explode(turns)).repartition(1).sortWithinPartitions("turn", "order", "label", F.xxhash64("buckets", "counts"))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, logits, labels = Learner(len(names)), [], []
        for batch in batches:
            turns, of_rows = batch.column(4).to_pylist(), batch.column(0).to_pylist()
            for k, (turn, label) in enumerate(zip(turns, of_rows, strict=True)):
                at, times = (batch.column(c)[k].values.to_numpy().astype(np.int64) for c in (2, 3))
                if not len(at):
                    continue
                values = times / times.sum() * SCALE * shared.value[at]
                if turn < PASSES:
                    learner.learn(at, values, label)
                else:
                    logits.append(values @ learner.weights(at) + learner.weights(slice(-1, None))[0])
                    labels.append(label)
        weights = learner.weights()
        temperature = best_temperature(np.array(logits).reshape(-1, len(names)), np.array(labels, np.int64))
        kept = np.flatnonzero(weights[:-1].any(1))
        rows = [*(weights[kept] * (SCALE * shared.value[kept])[:, None]), weights[-1], np.full(len(names), temperature)]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[kept, -1, -2]), pa.array([r.astype(np.float32) for r in rows], pa.list_(pa.float32()))], ["bucket", "weights"])

    order = features.columns + ["turn"]
    table = rows.select(*order).mapInArrow(learned, "bucket long, weights array<float>").toArrow()
    bucket = table.column("bucket").to_numpy()
    found = np.concatenate([c.flatten().to_numpy() for c in table.column("weights").chunks]).reshape(-1, len(names))
    weights = np.zeros((BUCKETS, len(names)), np.float32)
    weights[bucket[bucket >= 0]] = found[bucket >= 0]
    return LanguageModel(names, weights, found[bucket == -1][0].astype(float), float(found[bucket == -2][0, 0]))


def identify_language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``.

    Learned from the texts and non-null languages of rows that are not held out (rows without an id
    are). A prediction depends on the text alone: score is the likelihood of ``lang_pred`` among the
    learned languages. A null text and one without a letter are ``und`` with score 0, and so is every
    text if nothing is learned. Of a tie the first language by name is taken. Repeated rows are
    predicted alike; an empty table gives no rows; columns but doc_id, text and lang are not read.
    """
    shared = session(docs).sparkContext.broadcast(fitted(docs, sample))
    narrow = docs.select("doc_id", held_out(4, 2).alias("held_out"), "text")
    zero = narrow.select("doc_id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            names, scores = [], []
            for k in range(0, len(batch), BLOCK):
                found = scorer([t or "" for t in batch.column(2).slice(k, BLOCK).to_pylist()])
                names += found[0]
                scores.append(found[1])
            score = np.concatenate([np.zeros(0), *scores])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], zero.names)

    return narrow.mapInArrow(predicted, zero)
