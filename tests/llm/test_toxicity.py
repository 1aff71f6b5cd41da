"""The toxicity model learns from all labelled documents, however small its groups are."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from townlake.llm import labelled, toxicity


@pytest.fixture(scope="module")
def many(spark):
    """400 documents, of which each tenth is toxic by one word, and their labels."""
    rng = random.Random(3)
    plain = ["river", "stone", "garden", "window", "letter", "market", "bridge", "candle"]
    rows = [(i, " ".join(rng.choices(plain, k=20) + [f"topic{i % 40}"] + ["vileword"] * (i % 10 == 0)), "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    return rows, docs, docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))


def test_counts_and_thresholds_are_of_all_labelled_documents(many):
    rows, docs, labels = many
    model = toxicity.fitted(docs, labels, per_class=10)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 0]
    seen = toxicity.documents_with(*toxicity.numbered([toxicity.plain_words(r[1]) for r in learned]))
    assert (model.rows == toxicity.initial_model(seen, np.random.default_rng(10)).rows).all()
    # Each topic is in about eight of the documents; a sample of twenty has hardly any three times.
    own = model.rows[toxicity.buckets([f"topic{k}".encode() for k in range(40)])[:, 0]]
    assert (own > toxicity.RARE).all()
    apart = [r for r in learned if zlib.crc32(r[1].encode()) % toxicity.APART == 0]
    steps = np.rint(model.scores([r[1] for r in apart]) * toxicity.SCORE_STEPS) / toxicity.SCORE_STEPS
    toxic = np.array([int(r[0] % 10 == 0) for r in apart])
    expected = {"en": toxicity.calibrated(steps, toxic)} if toxic.sum() >= toxicity.LEAST_TOXIC else {}
    assert model.thresholds == pytest.approx(expected)


def test_all_groups_train_and_partitions_do_not_matter(many):
    rows, docs, labels = many
    one, other = (toxicity.fitted(d, labels, per_class=40) for d in (docs, docs.repartition(7, "text")))
    assert all((a == b).all() for a, b in zip([one.embedding, *one.filters, one.weights], [other.embedding, *other.filters, other.weights], strict=True))
    found = one.scores([r[1] for r in rows]) >= toxicity.THRESHOLD
    assert (found == np.array([r[0] % 10 == 0 for r in rows])).mean() > 0.97


def test_many_labels_are_joined(many):
    _, docs, labels = many
    sent, joined = (labelled.labelled_documents(docs, labels, "toxic", 5, 0, most_sent=n).orderBy("doc_id").collect() for n in (1000, 10))
    assert sent == joined and len(sent) > 300


def test_only_moved_rows_are_sent_and_the_mean_is_that_of_whole_networks(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(3000)]
    rows = [(i % 2, i, " ".join(rng.choices(words, k=120) + ["vileword"] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(60)]
    counted = toxicity.documents_with(*toxicity.numbered([toxicity.plain_words(r[2]) for r in rows]))
    start = toxicity.initial_model(counted, np.random.default_rng(10))
    sums = 0
    for group in (0, 1):
        own = sorted((r for r in rows if r[0] == group), key=lambda r: r[1])
        model = toxicity.trained(start, [r[2] for r in own], np.array([r[3] for r in own]), np.random.default_rng([10, group]), 1)
        moved = toxicity._fixed(model) - toxicity._fixed(start)
        assert len(toxicity.moved_rows(moved)[0]) < 0.7 * len(moved)
        sums = sums + toxicity._fixed(model) * len(own)
    mean = toxicity._of_flat(sums / len(rows) / toxicity.FIXED, start)
    grouped = spark.createDataFrame(rows, "group int, doc_id long, text string, label int")
    found = toxicity.averaged(grouped, spark.sparkContext.broadcast(start), 1)
    assert (found.embedding == mean.embedding).all() and (found.weights == mean.weights).all() and found.bias == mean.bias
