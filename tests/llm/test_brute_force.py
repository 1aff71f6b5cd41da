"""Fingerprints, votes, convolutions and shards against plain versions, and classifiers on held-out labels."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from townlake.llm import fingerprints, quality, sharding, toxicity
from townlake.llm.common import stored

TEXTS = ["", " ", "one", "one two three four five", "a b c d e f g", " ".join(f"w{i % 37}" for i in range(90)), " ".join(f"x{i}" for i in range(700)), "x " * 9000, "Ünï cödé ß"]


def test_fingerprints_equal_plain_one_permutation_hashing(spark):
    bins, low = fingerprints.BINS, (1 << fingerprints.LOW_BITS) - 1
    table = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r.t: (r.fp, r.h) for r in table.select("t", fingerprints.fingerprint(F.col("t")).alias("fp"), fingerprints.shingle_hashes(F.col("t")).alias("h")).collect()}
    number = F.col("b").cast("int")
    tries = spark.range(bins).withColumnRenamed("id", "b").select("b", F.array(*[F.xxhash64(number, F.lit(t)) for t in range(fingerprints.ATTEMPTS)]).alias("h")).collect()
    attempt = {r.b: [h % bins for h in r.h] for r in tries}
    pairs = spark.range(bins).withColumnRenamed("id", "b").crossJoin(spark.range(bins).withColumnRenamed("id", "c"))
    later = {(r.b, r.c): r.h for r in pairs.select("b", "c", F.xxhash64(number, F.col("c").cast("int"), F.lit(fingerprints.ATTEMPTS)).alias("h")).collect()}
    for text, (fp, hashes) in got.items():
        words = len(text.split())
        assert len(hashes) == (max(1, words - 4) if words else 0)
        if not words:
            assert fp == ""
            continue
        least = {}
        for h in hashes:
            b = (h >> 64 - fingerprints.BIN_BITS) + bins // 2  # signed: the lowest bin is that of the smallest numbers
            least[b] = min(h, least.get(b, h))
        values = []
        for b in range(bins):
            source = b if b in least else next((a for a in attempt[b] if a in least), None)
            if source is None:
                source = min(least, key=lambda c: later[b, c])
            values.append(least[source])
        assert fp == "".join(f"{v & low:02x}" for v in values), text[:20]
    fps = [fp for fp, _ in got.values()]
    rows = spark.createDataFrame([(a, b) for a in fps for b in fps], "a string, b string").select("a", "b", fingerprints.likeness(F.col("a"), F.col("b")).alias("l")).collect()
    for r in rows:
        agree = sum(r.a[i : i + 2] == r.b[i : i + 2] for i in range(0, 2 * bins, 2)) / bins
        assert abs(r.l - (float(r.a == r.b) if "" in (r.a, r.b) else max(0, (agree - 1 / 256) / (1 - 1 / 256)))) < 1e-9


def _labelled(sf, column, modulus, remainder):
    rows = duckdb.sql(f"SELECT d.doc_id, text, {column}, lang FROM '{sf}/documents.parquet' d JOIN '{sf}/labels.parquet' USING (doc_id) ORDER BY md5(d.doc_id::VARCHAR)").fetchall()
    held = lambda r: zlib.crc32(str(r[0]).encode()) % modulus == remainder
    return [r for r in rows if not held(r)], [r for r in rows if held(r)]


def _recall_precision(predicted, label):
    hit = (predicted & (label == 1)).sum()
    return hit / max(1, (label == 1).sum()), hit / max(1, predicted.sum())


def test_votes_equal_plain_ones_and_hold_out():
    train, held = _labelled("/root/testdata/sf0.1", "quality", 4, 2)
    train = [*[r for r in train if r[2] == 0][: quality.PER_CLASS], *[r for r in train if r[2] == 1][: quality.PER_CLASS]]
    model = quality.fit([r[1] for r in train], np.array([r[2] for r in train]), Counter(r[2] for r in train))
    texts = [r[1] for r in held]
    scores = model.scores(texts, quality.Featuriser())
    for text, score in list(zip(texts, scores, strict=True))[:60]:
        one = quality.folded([text], model.projection, quality.Featuriser())[0]
        cosines = sorted(((float(one @ v), w, g) for v, w, g in zip(model.vectors, model.votes, model.good, strict=True)), key=lambda x: -x[0])[: quality.NEIGHBOURS]
        weights = [max(c, 1e-3) ** quality.POWER * w for c, w, _ in cosines]
        assert abs(sum(w * g for w, (_, _, g) in zip(weights, cosines, strict=True)) / sum(weights) - score) < 1e-3
    recall, precision = _recall_precision(scores >= quality.THRESHOLD, np.array([r[2] for r in held]))
    assert recall >= 0.95 and precision >= 0.95


def test_long_words_and_shapes_count_whole():
    featurise = quality.Featuriser()
    long = "x1" * 40
    one, other = featurise(long + "a"), featurise(long + "b")
    assert set(one[0]) != set(other[0]) and quality.word_shape("a1" * 30) != quality.word_shape("a1" * 31)


def _small_model(rng):
    rows = np.full(toxicity.BUCKETS, toxicity.RARE, np.int32)
    rows[rng.integers(0, toxicity.BUCKETS, 4000)] = rng.integers(2, 30, 4000)
    model = toxicity._initial(rows, rng)
    for k, x in enumerate(model.biases):
        model.biases[k] = rng.normal(0, 0.1, x.shape)
    for name in ("embedding", "weights"):
        setattr(model, name, getattr(model, name).astype(float))
    model.filters = [f.astype(float) for f in model.filters]
    return model


def test_convolutions_equal_plain_ones():
    rng = np.random.default_rng(1)
    model = _small_model(rng)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8)).decode() for _ in range(60)]
    texts = ["", "one", *(" ".join(rng.choice(words, n)) for n in (2, 3, 40, 700))]
    for text, score in zip(texts, model.scores(texts), strict=True):
        tokens = toxicity.plain_words(text)
        vectors = [model.embedding[model.word_rows([t])[1]].sum(0) for t in tokens] + [model.embedding[model.word_rows([])[0]].sum(0)] * max(toxicity.WIDTHS)
        hidden = []
        for width, filters, biases in zip(toxicity.WIDTHS, model.filters, model.biases, strict=True):
            at = [np.concatenate(vectors[k : k + width]) @ filters + biases for k in range(len(vectors) - width + 1)]
            hidden += np.maximum(np.max(at, axis=0), 0).tolist()
        assert abs(1 / (1 + np.exp(-(np.array(hidden) @ model.weights + model.bias))) - score) < 1e-5


def test_gradients_of_convolutions_equal_differences():
    rng = np.random.default_rng(2)
    model, bias = _small_model(rng), np.array([0.1])
    shown = [rng.integers(1, 30, (n, toxicity.CHANNELS)) for n in (4, 9, 30)]
    toxic = np.array([1, 0, 1])

    def loss():
        total = 0.0
        for rows, y in zip(shown, toxic, strict=True):
            words = model.embedding[rows].sum(1)
            hidden = np.concatenate([
                np.maximum(np.max([words[k : k + w].ravel() @ f for k in range(len(words) - w + 1)], axis=0) + b, 0) for w, f, b in zip(toxicity.WIDTHS, model.filters, model.biases, strict=True)
            ])
            z = hidden @ model.weights + bias[0]
            total += np.log1p(np.exp(-z)) if y else np.log1p(np.exp(z))
        return total / len(shown) + 0.5e-5 * sum((f * f).sum() for f in model.filters) + 0.5e-4 * (model.weights**2).sum()

    params = [model.embedding, *model.filters, *model.biases, model.weights, bias]
    gradients = toxicity._gradients(model, bias, shown, toxic)
    for values, gradient in zip(params, gradients, strict=True):
        for at in rng.choice(values.size, min(8, values.size), replace=False):
            if values is model.embedding and at < toxicity.DIMENSIONS:
                continue  # padding stays as it is
            before = values.flat[at]
            ends = []
            for by in (1e-6, -1e-6):
                values.flat[at] = before + by
                ends.append(loss())
            values.flat[at] = before
            assert abs((ends[0] - ends[1]) / 2e-6 - gradient.flat[at]) < 1e-5


def test_toxic_documents_are_found_among_held_out_ones():
    train, held = _labelled("/root/testdata/sf0.1", "toxic", 5, 0)
    counts = Counter(r[2] for r in train)
    train = [*[r for r in train if r[2] == 0][: toxicity.PER_CLASS], *[r for r in train if r[2] == 1][: toxicity.PER_CLASS]]
    model = toxicity.fit([r[1] for r in train], [r[3] for r in train], np.array([r[2] for r in train]), counts)
    recall, precision = _recall_precision(model.scores([r[1] for r in held]) >= toxicity.THRESHOLD, np.array([r[2] for r in held]))
    assert recall >= 0.85 and precision >= 0.85


def _cut(rows):
    """Rows of a link that are not where most of its rows are."""
    by = defaultdict(Counter)
    for link, shard in rows:
        by[link][shard] += 1
    return sum(sum(c.values()) - max(c.values()) for c in by.values())


@pytest.mark.parametrize("shards", [3, 8])
def test_propagation_cuts_few_links_and_keeps_counts_even(spark, shards):
    rng = random.Random(shards)
    groups = [g for g in range(120) for _ in range(rng.choice((1, 2, 2, 3, 5, 9)))]
    table = spark.createDataFrame([(i, f"text {g}") for i, g in enumerate(groups)], "doc_id long, text string").repartition(3)
    got = sharding.shard_documents(table, shards).collect()
    links = [(r.text_crc32, r.shard) for r in got]
    start = [(g, hash((i, 7)) % shards) for i, g in enumerate(groups)]
    sizes = Counter(s for _, s in links)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and _cut(links) <= 0.25 * _cut(start)


def test_a_hot_link_meets_its_counts_in_parts(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"l{i}", f"{i:08x}") for i in range(3000)], "vertex long, link string, key string")
    shards = stored(rows.select("vertex", F.pmod("vertex", F.lit(8)).cast("int").alias("shard")), "shards")
    moves = {r.vertex: r.to for r in sharding.propose_moves(rows, shards).collect()}
    sizes = Counter(i % 8 for i in range(3000) if i % 3)
    most = {s for s, n in sizes.items() if n == max(sizes.values())}
    assert set(moves.values()) <= most and all(i % 3 for i in moves)


def test_mix_keeps_columns_of_any_name(spark):
    """Names that the mix uses itself come back as they were."""
    from townlake.llm.mixing import mixed_documents

    own = ["_size", "_name", "_taken", "_id", "_nth", "_words", "_first", "size", "name", "id", "taken", "nth", "words", "first", "new_text", "row", "key", "target", "source_size", "before"]
    rows = [(i, " ".join(f"w{k}" for k in range(i % 7)), f"s{i % 3}", i % 7 * 3, *[f"{c}-{i}" for c in own]) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in own))
    got = mixed_documents(table)
    plain = mixed_documents(table.select("doc_id", "text", "source", "n_chars"))
    assert got.columns == table.columns
    assert all(r[c] == f"{c}-{r.doc_id}" for r in got.collect() for c in own)
    key = lambda df: sorted((r.doc_id, r.text, r.n_chars) for r in df.collect())
    assert key(got) == key(plain)
