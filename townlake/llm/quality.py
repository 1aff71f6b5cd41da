"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled documents is turned into weighted feature counts, a truncated
singular value decomposition makes vectors of them, and those vectors are broadcast. Every
document is folded into the same space; blocks of documents take exact cosines with all labelled
vectors in one matrix product, and the nearest neighbours vote with a power of their similarity.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townlake.llm.common import give_back_memory, session
from townlake.llm.labelled import held_out, labelled_sample

#: Labelled documents of each class that the space and the votes are fitted on.
PER_CLASS = 1500
FEATURES = 4096
RANK = 48
NEIGHBOURS = 15
POWER = 8.0
THRESHOLD = 0.7
#: Words whose features a task remembers, and their longest.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 64
#: Texts folded and compared at once.
BLOCK = 128

_LETTERS = [(re.compile(p), r) for p, r in (("[^\\W\\d_]", "a"), ("\\d", "0"), ("(.)\\1+", "\\1"))]


def _feature(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % FEATURES


def word_shape(word: str) -> str:
    """Letters as a, A or Aa by case, digits as 0, signs as they are, runs once."""
    case = "A" if word.isupper() and len(word) > 1 else "T" if word[:1].isupper() else "l"
    shape = word
    for pattern, by in _LETTERS:
        shape = pattern.sub(by, shape)
    return case + shape


class Featuriser:
    """Feature ids and weights of a text: its words, their shapes, and how it repeats them."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def _word(self, word: str) -> tuple[int, int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = (_feature("w " + word), _feature("s " + word_shape(word)))
            if len(word) <= LONGEST_REMEMBERED:
                self.known[word] = found
        return found

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        counts = Counter(words)
        n = len(words)
        pairs = np.array([self._word(w) for w in counts], np.int64).reshape(-1, 2)
        times = np.fromiter(counts.values(), np.float64, len(counts))
        distinct = len(counts) / n if n else 0.0
        most = max(counts.values(), default=0) / n if n else 0.0
        lines = [x for x in text.split("\n") if x]
        whole = [
            f"length {min(n, 40) // 4}",
            f"distinct {int(10 * distinct ** (1 + np.log10(n + 1) / 4))}",
            f"most {int(20 * most)}",
            f"lines {int(5 * len(set(lines)) / len(lines)) if lines else -1}",
            f"wordlength {min(20, len(text) // (n + 1))}",
        ]
        ids = np.concatenate([pairs[:, 0], pairs[:, 1], [_feature("d " + x) for x in whole]]).astype(np.int64)
        # Words count little, shapes by their share, what describes the whole text counts most.
        share = times / max(n, 1)
        weights = np.concatenate([0.5 * np.log1p(times) / np.sqrt(len(counts) + 1), 3 * share, np.full(len(whole), 0.7)])
        return ids, weights


def _sums(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, bounds[:-1], axis=0)


def folded(texts: list[str], projection: np.ndarray, featurise: Featuriser) -> np.ndarray:
    """Unit vectors of texts. Every text has features, so none is a zero vector by lack of words."""
    found = [featurise(t) for t in texts]
    bounds = np.cumsum([0] + [len(ids) for ids, _ in found])
    ids = np.concatenate([i for i, _ in found])
    weights = np.concatenate([w for _, w in found]).astype(np.float32)
    vectors = _sums(projection[ids] * weights[:, None], bounds)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


@dataclass
class QualityModel:
    """The space and the labelled vectors: a few megabytes, whatever the size of the corpus."""

    projection: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    good: np.ndarray

    def scores(self, texts: list[str], featurise: Featuriser) -> np.ndarray:
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.votes))
        for a in range(0, len(texts), BLOCK):
            cosines = folded(texts[a : a + BLOCK], self.projection, featurise) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-3) ** POWER * self.votes[near]
            out[a : a + BLOCK] = (weight * self.good[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def fit(texts: list[str], good: np.ndarray, class_counts: dict[int, int], seed: int = 5) -> QualityModel | None:
    """None without labels. Votes are weighted so that the sample's classes weigh as all labels do."""
    if not texts:
        return None
    featurise, rng = Featuriser(), np.random.default_rng(seed)
    matrix = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in enumerate(texts):
        ids, weights = featurise(text)
        np.add.at(matrix[row], ids, weights.astype(np.float32))
    rarity = np.sqrt(np.log((1 + len(texts)) / (1 + (matrix > 0).sum(0))) + 0.2).astype(np.float32)
    matrix *= rarity
    rank = min(RANK, *matrix.shape)
    basis = matrix.T @ (matrix @ rng.standard_normal((FEATURES, rank + 8)).astype(np.float32))
    for _ in range(3):
        basis = matrix.T @ (matrix @ np.linalg.qr(basis)[0])
    basis = np.linalg.qr(basis)[0]
    _, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
    projection = (rarity[:, None] * (basis @ right[:rank].T)).astype(np.float32)
    sampled = Counter(int(x) for x in good)
    votes = np.array([class_counts[int(x)] / sampled[int(x)] for x in good], np.float32)
    parts = [folded(texts[a : a + BLOCK], projection, featurise) for a in range(0, len(texts), BLOCK)]
    vectors = np.concatenate(parts).astype(np.float32)
    return QualityModel(projection, vectors, votes, good.astype(np.float32))


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel | None:
    sample, counts = labelled_sample(docs, labels, "quality", 4, 2, per_class)
    rows = sorted(sample.select("doc_id", "text", "label").collect())
    model = fit([r["text"] for r in rows], np.array([r["label"] for r in rows], np.int64), counts)
    del rows
    give_back_memory()
    return model


def with_scores(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """Add ``score`` to ``docs``, which must not have such a column."""
    if model is None:
        return docs.withColumn("score", F.lit(1.0))
    shared = session(docs).sparkContext.broadcast(model)
    schema = docs.withColumn("score", F.lit(0.0)).schema
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurise = Featuriser()
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            found = shared.value.scores(texts, featurise) if texts else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [f"c{i}" for i in range(len(schema))])

    return docs.mapInArrow(score, schema)


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from THRESHOLD on) for every row of ``docs``.

    Scores depend on the text alone; null counts as empty, and an empty text is scored like any
    other. Labels of held-out rows (and of null ids) are not learned. Without any label every
    score is 1: nothing is known against a text. Repeated rows score alike; an empty table gives
    no rows; other columns are not read.
    """
    narrow = docs.select("doc_id", "text")
    return with_scores(narrow, fitted(docs, labels, per_class)).select(
        "doc_id",
        held_out(4, 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    renamed = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"_c{i}") for i, c in enumerate(docs.columns)])
    kept = with_scores(renamed, fitted(docs, labels)).where(F.col("score") >= THRESHOLD)
    return kept.select(*[F.col("text" if c == "text" else f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
