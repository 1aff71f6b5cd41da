"""Language identification: held-out accuracy, the learner against plain formulas, awkward rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from townlake.llm import language, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, score string, label int, bucket string"


def plain_grams(word):
    signed = f"\x02{word}\x03"
    return [signed[i : i + n] for n in range(1, language.LONGEST_GRAM + 1) for i in range(len(signed) - n + 1)]


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op11_language"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = [r.lang == r.lang_pred for r in rows]
    assert len(rows) > 200 and sum(right) / len(right) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert abs(sum(r.score for r in rows) / len(rows) - sum(right) / len(right)) < 0.03  # as sure as it is right


def test_grams_are_those_of_each_word():
    words = ["a", "straße", "日本", "the", "x" * 90]
    buckets, sizes = language.grams(words)
    assert sizes.tolist() == [len(plain_grams(w)) for w in words]
    alone = [language.grams([w])[0].tolist() for w in words]
    assert buckets.tolist() == [b for part in alone for b in part]
    found = {}
    for part, w in zip(alone, words, strict=True):
        for g, b in zip(plain_grams(w), part, strict=True):
            assert found.setdefault(g, b) == b  # one n-gram, one bucket
    assert len(set(found.values())) > 0.99 * len(found)


def test_features_count_whole_texts():
    text = "The the cat, THE Straße; " * 50 + "end"
    buckets, counts = language.WordGrams().features(text)
    want = Counter(int(b) for w in language.words_of(text) for b in language.grams([w])[0])
    assert dict(zip(buckets.tolist(), counts.tolist(), strict=True)) == dict(want)


def test_learner_equals_the_rule_by_hand():
    """Each weight by its own sums: z, n, soft threshold by L1, step by sqrt(n)."""
    rng = random.Random(3)
    learner = language.Learner(3, buckets=7)
    z, n = [[0.0] * 3 for _ in range(8)], [[0.0] * 3 for _ in range(8)]

    def weight(i, k):
        if abs(z[i][k]) <= language.L1:
            return 0.0
        return -(z[i][k] - math.copysign(language.L1, z[i][k])) / ((language.BETA + math.sqrt(n[i][k])) / language.ALPHA + language.L2)

    for _ in range(200):
        rows = sorted(rng.sample(range(7), 3))
        values, label = [rng.random() for _ in rows], rng.randrange(3)
        learner.learn(np.array(rows), np.array(values), label)
        pairs = [*zip(rows, values, strict=True), (7, 1.0)]
        logits = [sum(v * weight(i, k) for i, v in pairs) for k in range(3)]
        total = sum(math.exp(x) for x in logits)
        gradient = [math.exp(x) / total - (k == label) for k, x in enumerate(logits)]
        for i, v in pairs:
            for k in range(3):
                g, w = v * gradient[k], weight(i, k)
                z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / language.ALPHA * w
                n[i][k] += g * g
    assert np.allclose(learner.weights(), [[weight(i, k) for k in range(3)] for i in range(8)])


def test_penalty_leaves_weights_at_zero():
    learner = language.Learner(2, buckets=100, l1=2.0)
    rng = np.random.default_rng(1)
    for i in range(400):
        label = i % 2
        rows = np.unique(np.r_[label, rng.integers(2, 100, 5)])
        learner.learn(rows, np.ones(len(rows)), label)
    w = learner.weights()
    assert (w[:2] != 0).any() and (w[2:100] == 0).mean() > 0.5 and w[0, 0] > 0 > w[0, 1]


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 3, 500)
    logits = 9 * rng.standard_normal((500, 3)) + 4 * np.eye(3)[labels]
    loss = lambda t: -np.log(language.softmax(logits / t)[np.arange(500), labels]).mean()
    found = language.best_temperature(logits, labels)
    assert found > 1.5 and loss(found) <= min(map(loss, np.exp(np.linspace(-3, 3, 200)))) + 0.01
    assert language.best_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    make = lambda signs: " ".join("".join(rng.choice(signs) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 30)))
    known = [(i, make(s), name, "s", "x", 1, "b") for i, (s, name) in enumerate([("abcde", "aa"), ("xyzäö", "zz")] * 120)]
    odd = [None, "", " \n", "12345 !?", "٣٤", "ab cde " * 60_000, "日本語", "x", "ß", "xyz äö", "xyz äö"]
    return known + [(1000 + i, t, (None, "zz", "aa")[i % 3], None, None, None, None) for i, t in enumerate(odd)] + [(None, "abc de", "zz", "s", "x", 1, "b")]


def test_awkward_rows(spark, rows):
    got = language.identify_language(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [(by_id[1000 + i].lang_pred, by_id[1000 + i].score) for i in range(5)] == [("und", 0.0)] * 5
    assert by_id[1005].lang_pred == "aa" and by_id[1009].lang_pred == by_id[1010].lang_pred == "zz"
    assert by_id[None].held_out and all(r.held_out is not None for r in got)
    assert all(by_id[d].lang_pred == lang for d, _, lang, *_ in rows[:240])


def test_predictions_do_not_depend_on_partitions_or_on_held_out_rows(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    first = {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in language.identify_language(table.repartition(2)).collect()}
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    wrong = table.withColumn("lang", F.when(held, F.lit("qq")).otherwise(F.col("lang"))).repartition(5)
    assert {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in language.identify_language(wrong).collect()} == first


def test_nothing_to_learn_from(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert language.identify_language(none).collect() == []
    without = spark.createDataFrame([(d, t, None, None, None, None, None) for d, t, *_ in rows[:5]], SCHEMA)
    assert {(r.lang_pred, r.score) for r in language.identify_language(without).collect()} == {("und", 0.0)}
