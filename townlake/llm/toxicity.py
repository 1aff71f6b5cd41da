"""Toxicity scores by a convolutional text classifier.

A word's embedding is the sum of the hashed rows of the word and of its beginnings; filters of
several widths slide over the words, each filter keeps its largest value in the text, and a
logistic layer makes a score of those. All labelled documents are learned from: every one is counted
for the vocabulary, groups of some thousand documents, dealt by hash, each train the network in numpy
from a common start, and the networks are averaged. Scoring finds the filters' responses to each
distinct word of a block of texts once, so a text of any length takes a few table look-ups a word.
Thresholds for flags are calibrated by language, beside the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townlake.llm.common import session, stored
from townlake.llm.labelled import held_out, labelled_documents

#: A group that trains the network has about twice as many documents.
PER_CLASS = 2000
BUCKETS = 1 << 18
#: A bucket has an embedding of its own if at least as many training documents have it.
LEAST_DOCUMENTS = 3
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Times that the first group goes over its documents, which makes the start, and that all groups do from there.
EPOCHS, FURTHER_EPOCHS = 8, 2
#: One of so many documents sets thresholds only.
APART = 10
#: Parts of the score that thresholds tell apart, and toxic documents that a language's threshold needs.
SCORE_STEPS, LEAST_TOXIC = 1 << 16, 5
#: Numbers of the networks are added up as whole numbers of this part of one, so that no order matters.
FIXED = 1 << 24
#: Share of the words that training leaves out, anew each time, so that each word learns to tell alone.
WORD_DROPOUT = 0.5
BATCH = 48
THRESHOLD = 0.5
#: Words scored at once; longer texts are scored in parts that overlap by the widest filter.
PART = 1 << 18

#: Lengths in bytes of the beginnings of a word that have embeddings, beside the whole word.
STEMS = (4, 5, 6, 7)
CHANNELS = 1 + len(STEMS)

_SIGNS = bytes(32 if chr(b) in "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~'-" else b for b in range(256))
#: Row 0 of the embedding is padding and stands for rare stems, row 1 for rare words.
PAD, RARE = 0, 1


def plain_words(text: str) -> list[bytes]:
    """The words of a whole text, in lower case and without signs."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SIGNS).split()


def numbered(texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[bytes]]:
    """Texts as numbers of their words, from 1 on, and the distinct words; 0 is left for padding."""
    known: dict[bytes, int] = {}
    ids = [np.fromiter([known.setdefault(w, len(known) + 1) for w in t], np.int32, len(t)) for t in texts]
    return ids, list(known)


def buckets(words: list[bytes]) -> np.ndarray:
    """The hash buckets of each word and its stems, -1 for a stem that the word is too short for."""
    out = np.full((len(words), CHANNELS), -1, np.int64)
    for k, w in enumerate(words):
        out[k, 0] = zlib.crc32(w) % BUCKETS
        for c, n in enumerate(STEMS, 1):
            if len(w) > n:
                out[k, c] = zlib.crc32(b"%d %s" % (n, w[:n])) % BUCKETS
    return out


@dataclass
class ConvModel:
    rows: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def word_rows(self, words: list[bytes]) -> np.ndarray:
        """Embedding rows of each word's channels, after those of padding."""
        found = buckets(words)
        rows = self.rows[found]
        rows[found < 0] = PAD
        rows[:, 1:][rows[:, 1:] == RARE] = PAD
        return np.concatenate([np.full((1, CHANNELS), PAD, rows.dtype), rows])

    def pooled(self, texts: list[np.ndarray], embedded: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each text, given the embeddings of its words.

        Every text is followed by padding, so that none is empty. Places from which a filter would
        reach into the next text do not count.
        """
        pad = np.zeros(max(WIDTHS), np.int32)
        ids = np.concatenate([x for t in texts for x in (t, pad)])
        bounds = np.cumsum([0] + [len(t) + len(pad) for t in texts])
        out = []
        for width, w, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            places = [embedded @ w[j * DIMENSIONS : (j + 1) * DIMENSIONS] for j in range(width)]
            response = places[0][ids]
            for j in range(1, width):
                response[:-j] += places[j][ids[j:]]
                response[bounds[1:] - j] = -np.inf
            out.append(np.maximum(np.maximum.reduceat(response, bounds[:-1], axis=0) + b, 0))
        return np.concatenate(out, axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        pooled = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        block, owner, held = [], [], 0

        def finish() -> None:
            ids, words = numbered(block)
            np.maximum.at(pooled, owner, self.pooled(ids, self.embedding[self.word_rows(words)].sum(1)))

        for i, text in enumerate(texts):
            words = plain_words(text)
            for a in range(0, max(1, len(words)), PART):
                if block and held + len(words) - a > PART:
                    finish()
                    block, owner, held = [], [], 0
                block.append(words[a : a + PART + max(WIDTHS)])
                owner.append(i)
                held += len(block[-1])
        if block:
            finish()
        return 1 / (1 + np.exp(-np.clip(pooled @ self.weights + self.bias, -30, 30).astype(float)))


def _initial(rows: np.ndarray, rng: np.random.Generator) -> ConvModel:
    n = int(rows.max()) + 1
    embedding = rng.normal(0, 0.1, (n, DIMENSIONS)).astype(np.float32)
    embedding[PAD] = 0
    filters = [rng.normal(0, (2 / (w * DIMENSIONS)) ** 0.5, (w * DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    return ConvModel(
        rows, embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32), 0.0,
    )


class _Adam:
    """Steps of bounded size for a few arrays; an embedding's rows step only where they are used."""

    def __init__(self, arrays: list[np.ndarray], rate: float) -> None:
        self.rate, self.t = rate, 0
        self.m = [np.zeros_like(a) for a in arrays]
        self.v = [np.zeros_like(a) for a in arrays]

    def step(self, arrays: list[np.ndarray], gradients: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(arrays, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-6)


def _gradients(model: ConvModel, bias: np.ndarray, shown: list[np.ndarray], toxic: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy of a batch, and of a small penalty on filters and weights.

    For embedding, filters, biases, weights and bias. ``shown`` has the embedding rows of each text's
    words; only the words at which a filter is largest get a gradient.
    """
    best = np.zeros((len(shown), len(WIDTHS), FILTERS), np.int64)
    top = np.zeros((len(shown), len(WIDTHS), FILTERS), model.embedding.dtype)
    for k, rows in enumerate(shown):
        words = model.embedding[rows].sum(1)
        for f, width in enumerate(WIDTHS):
            n = len(words) - width + 1
            spread = np.concatenate([words[j : n + j] for j in range(width)], axis=1)
            response = spread @ model.filters[f]
            best[k, f] = response.argmax(0)
            top[k, f] = np.take_along_axis(response, best[k, f][None], 0)[0] + model.biases[f]
    hidden = np.maximum(top, 0).reshape(len(shown), -1)
    z = hidden @ model.weights + bias[0]
    error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic).astype(top.dtype) / len(shown)
    back = (error[:, None] * model.weights).reshape(top.shape) * (top > 0)
    g_embedding = np.zeros_like(model.embedding)
    g_filters, g_biases = [], []
    for f, width in enumerate(WIDTHS):
        g = np.zeros_like(model.filters[f])
        for j in range(width):
            ids = np.stack([rows[best[k, f] + j] for k, rows in enumerate(shown)])
            span = slice(j * DIMENSIONS, (j + 1) * DIMENSIONS)
            g[span] = np.einsum("kfd,kf->df", model.embedding[ids].sum(2), back[:, f])
            into = back[:, f, :, None] * model.filters[f][span].T[None]
            np.add.at(g_embedding, ids, into[:, :, None, :])
        g_filters.append(g + 1e-5 * model.filters[f])
        g_biases.append(back[:, f].sum(0))
    g_embedding[PAD] = 0
    return [g_embedding, *g_filters, *g_biases, hidden.T @ error + 1e-4 * model.weights, error.sum(keepdims=True)]


def _train(model: ConvModel, texts: list[np.ndarray], by_word: np.ndarray, toxic: np.ndarray, rng: np.random.Generator, epochs: int) -> None:
    """Adam by batches; each time other words are left out. ``texts`` are numbers of words, of which ``by_word`` has the embedding rows."""
    bias = np.full(1, model.bias, np.float32)
    params = [model.embedding, *model.filters, *model.biases, model.weights, bias]
    adam, pad = _Adam(params, 0.01), np.zeros(max(WIDTHS), np.int32)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            chosen = order[a : a + BATCH]
            padded = [by_word[np.concatenate([texts[i], pad])] for i in chosen]
            shown = [np.where(rng.random((len(x), 1)) < WORD_DROPOUT, PAD, x) for x in padded]
            adam.step(params, _gradients(model, bias, shown, toxic[chosen]))
    model.bias = float(bias[0])


def calibrated(scores: np.ndarray, toxic: np.ndarray, documents: np.ndarray | None = None) -> float:
    """The threshold with the best F1, between the scores that it parts; a score may stand for several ``documents``."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(toxic[order])
    above = np.arange(1, len(order) + 1) if documents is None else np.cumsum(documents[order])
    f1 = 2 * hits / (above + max(1, toxic.sum()))
    k = int(f1.argmax())
    below = scores[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((scores[order[k]] + below) / 2)


def documents_with(ids: list[np.ndarray], words: list[bytes]) -> np.ndarray:
    """In how many texts each bucket occurs."""
    hashed = np.concatenate([np.full((1, CHANNELS), -1), buckets(words)])
    seen = np.zeros(BUCKETS, np.int64)
    for t in ids:
        found = np.unique(hashed[np.unique(t)])
        seen[found[found >= 0]] += 1
    return seen


def initial_model(seen: np.ndarray, rng: np.random.Generator) -> ConvModel:
    """An untrained network; buckets that at least LEAST_DOCUMENTS texts have get embeddings of their own."""
    rows = np.full(BUCKETS, RARE, np.int32)
    own = np.flatnonzero(seen >= LEAST_DOCUMENTS)
    rows[own] = np.arange(len(own)) + 2
    return _initial(rows, rng)


def trained(model: ConvModel, texts: list[str], toxic: np.ndarray, rng: np.random.Generator, epochs: int) -> ConvModel:
    """A copy of ``model`` that has gone over some texts ``epochs`` times."""
    copy = ConvModel(
        model.rows, model.embedding.copy(), [x.copy() for x in model.filters], [x.copy() for x in model.biases], model.weights.copy(), model.bias
    )
    ids, words = numbered([plain_words(t) for t in texts])
    _train(copy, ids, copy.word_rows(words), toxic, rng, epochs)
    return copy


def fit(texts: list[str], langs: list[str | None], toxic: np.ndarray, class_counts: dict[int, int], seed: int = 10) -> ConvModel | None:
    """A model of texts that one process holds; None unless both labels occur. One tenth of them sets the thresholds only."""
    if len(set(toxic.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    apart = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % APART == 0 for t in texts])
    train = np.flatnonzero(~apart) if len(set(toxic[~apart].tolist())) == 2 else np.arange(len(texts))
    model = initial_model(documents_with(*numbered([plain_words(t) for t in texts])), rng)
    model = trained(model, [texts[i] for i in train], toxic[train], rng, EPOCHS)
    # The texts may hold the classes in other shares than the labels do.
    sampled = [int((toxic == c).sum()) for c in (0, 1)]
    model.bias += float(np.log(class_counts[1] / sampled[1]) - np.log(class_counts[0] / sampled[0]))
    scores = model.scores(texts)
    by_lang = np.array([x or "" for x in langs])
    for lang in sorted(set(by_lang)):
        here = apart & (by_lang == lang)
        if toxic[here].sum() >= LEAST_TOXIC:
            model.thresholds[lang] = calibrated(scores[here], toxic[here])
    return model


def counted_buckets(texts: DataFrame) -> np.ndarray:
    """In how many of all texts each bucket occurs: every task counts its own, Spark adds them up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            seen += documents_with(*numbered([plain_words(x) for x in batch.column(0).to_pylist()]))
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen[own])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(BUCKETS, np.int64)  # there are BUCKETS rows at most
    for r in rows:
        seen[r["bucket"]] = r["n"]
    return seen


def _flat(model: ConvModel) -> np.ndarray:
    """All numbers of a network in rows of DIMENSIONS."""
    parts = [model.embedding, *model.filters, *model.biases, model.weights, np.array([model.bias])]
    flat = np.concatenate([x.ravel().astype(np.float64) for x in parts])
    return np.pad(flat, (0, -len(flat) % DIMENSIONS)).reshape(-1, DIMENSIONS)


def _of_flat(flat: np.ndarray, like: ConvModel) -> ConvModel:
    flat, at = flat.ravel(), 0

    def take(x: np.ndarray) -> np.ndarray:
        nonlocal at
        at += x.size
        return flat[at - x.size : at].reshape(x.shape).astype(np.float32)

    return ConvModel(like.rows, take(like.embedding), [take(x) for x in like.filters], [take(x) for x in like.biases], take(like.weights), float(flat[at]))


def _fixed(model: ConvModel) -> np.ndarray:
    return np.rint(_flat(model) * FIXED).astype(np.int64)


def moved_rows(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that training has moved, and their places: words that no filter took leave an embedding's rows as they are."""
    at = np.flatnonzero(sums.any(1))
    return at, sums[at]


def averaged(grouped: DataFrame, start: Broadcast, epochs: int) -> ConvModel | None:
    """The mean of the networks that groups of documents make of ``start``, each by its documents; None without any.

    ``grouped`` has (group, doc_id, text, label). A task holds one group's texts and the sum of what its networks
    differ by from ``start``; Spark adds the sums up, row by row of the embedding. Rows without a difference are not sent.
    """
    names = [f"v{i}" for i in range(DIMENSIONS)]

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents, held, last, before = None, 0, [], None, _fixed(start.value)

        def learn() -> None:
            nonlocal total, documents
            rng = np.random.default_rng([10, last])
            model = trained(start.value, [t for t, _ in held], np.array([x for _, x in held], np.int64), rng, epochs)
            sums = (_fixed(model) - before) * len(held)
            total = sums if total is None else total + sums
            documents += len(held)

        for batch in batches:
            for group, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and group != last:
                    learn()
                    held = []
                last = group
                held.append((text, label))
        if held:
            learn()
            # Row -1 has how many documents these are.
            yield pa.RecordBatch.from_arrays([pa.array([-1]), *(pa.array([documents]) for _ in names)], ["at", *names])
            at, sums = moved_rows(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(sums[:, i]) for i in range(DIMENSIONS))], ["at", *names])

    dealt = grouped.repartition("group").sortWithinPartitions("group", "doc_id", "text", "label").select("group", "text", "label")
    schema = "at long, " + ", ".join(f"{n} long" for n in names)
    rows = dealt.mapInArrow(train, schema).groupBy("at").agg(*[F.sum(n).alias(n) for n in names])
    table = rows.toArrow()  # as many rows as the embedding has, and a few
    found = np.stack([table["at"].to_numpy(), *(table[n].to_numpy() for n in names)], axis=1)
    if not len(found):
        return None
    found = found[np.argsort(found[:, 0])]
    documents, sums = found[0, 1], _fixed(start.value)
    sums *= documents
    sums[found[1:, 0]] += found[1:, 1:]
    return _of_flat(sums / documents / FIXED, start.value)


def language_thresholds(apart: DataFrame, model: Broadcast) -> dict[str, float]:
    """By language the threshold with the best F1 on all documents that are kept apart; without LEAST_TOXIC toxic ones there is none."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.rint(model.value.scores(batch.column(0).to_pylist()) * SCORE_STEPS).astype(np.int64) if len(batch) else []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *batch.columns[1:]], ["step", "lang", "label"])

    scored = apart.select("text", F.coalesce("lang", F.lit("")).alias("lang"), "label").mapInArrow(score, "step long, lang string, label int")
    steps = scored.groupBy("lang", "step").agg(F.sum("label").alias("toxic"), F.count("*").alias("documents"))
    out: dict[str, list] = {}
    for r in steps.orderBy("lang", "step").collect():  # SCORE_STEPS rows a language at most
        out.setdefault(r["lang"], []).append((r["step"] / SCORE_STEPS, r["toxic"], r["documents"]))
    columns = {lang: [np.array(c) for c in zip(*rows, strict=True)] for lang, rows in out.items()}
    return {lang: calibrated(*c) for lang, c in columns.items() if c[1].sum() >= LEAST_TOXIC}


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ConvModel | None:
    """The model of all labelled documents that are not held out; None unless both labels occur.

    Counts are of all of them. One in APART sets the thresholds only; all others train, in groups of about
    2 * ``per_class``: the first makes the start, from which all groups go on.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    known = labelled_documents(docs.select("doc_id", "text", lang.alias("lang")), labels, "toxic", 5, 0, ("lang",))
    known = stored(known.withColumn("apart", F.crc32("text") % APART == 0), "labelled")
    counts = {(r["apart"], r["label"]): r["n"] for r in known.groupBy("apart", "label").agg(F.count("*").alias("n")).collect()}
    if {label for _, label in counts} != {0, 1}:
        return None
    both = {label for apart, label in counts if not apart} == {0, 1}
    train = known.where("not apart") if both else known
    n = sum(k for (apart, _), k in counts.items() if not (both and apart))
    groups = max(1, round(n / (2 * per_class)))
    grouped = train.withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))
    share = session(docs).sparkContext.broadcast
    model = initial_model(counted_buckets(known), np.random.default_rng(10))
    model = averaged(grouped.where("group = 0"), share(model), EPOCHS) or model
    if groups > 1:
        model = averaged(grouped, share(model), FURTHER_EPOCHS)
    model.thresholds = language_thresholds(known.where("apart"), share(model))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold, flagged for every row of ``docs``.

    ``score`` depends on the text alone and ``predicted`` is 1 from THRESHOLD on. ``flagged``
    holds the score against the threshold calibrated for the row's language (THRESHOLD where the
    documents kept apart have under five toxic texts of it). Null texts count as empty and are scored like any
    other. Labels of held-out rows (and of null ids) are not learned; without labels of both
    kinds every score is 0. Repeated rows score alike; an empty table gives no rows.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    narrow = docs.select("doc_id", "text", lang.alias("lang"))
    model = fitted(docs, labels, per_class)
    if model is None:
        scored = narrow.select("doc_id", "lang", F.lit(0.0).alias("score"))
        thresholds = {}
    else:
        shared, thresholds = session(docs).sparkContext.broadcast(model), model.thresholds

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shared.value.scores([x or "" for x in batch.column(1).to_pylist()]) if len(batch) else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(found, pa.float64())], ["doc_id", "lang", "score"]
                )

        scored = narrow.mapInArrow(score, narrow.select("doc_id", "lang", F.lit(0.0).alias("score")).schema)
    threshold = F.lit(THRESHOLD)
    for name, value in sorted(thresholds.items()):
        threshold = F.when(F.coalesce("lang", F.lit("")) == name, F.lit(value)).otherwise(threshold)
    return scored.select(
        "doc_id",
        held_out(5, 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        threshold.alias("lang_threshold"),
        (F.col("score") >= threshold).alias("flagged"),
    )
