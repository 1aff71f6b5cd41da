"""The training-data operators against plain Python, on small and on awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from townlake.llm import (
    exact_dedup,
    fingerprints,
    labelled,
    lm_scoring,
    mixing,
    near_copies,
    packing,
    quality,
    queries,
    recurrent,
    repeats,
    sharding,
    simhash,
    toxicity,
    transform,
)
from townlake.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def awkward_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 977} Töpfe{i}" for i in range(6000))
    return [
        (1, "the cat sat on the mat and then it went out", "en", "b", 43),
        (2, "the cat sat on  the mat and then it went out\n", "en", "a", 44),
        (3, None, None, None, None),
        (4, "", "de", "a", 0),
        (5, " \t\n", "fr", None, 3),
        (6, long, "en", "c", len(long)),
        (7, "stupid scum idiot loser", "en", "a", 23),
        (8, "Ünïcödé Straße ß ÄÖÜ", None, "b", 20),
        (8, "Ünïcödé Straße ß ÄÖÜ", None, "b", 20),
        (None, "no id here at all for this text", "en", "b", 31),
        (9, long + " end", "en", "c", len(long) + 4),
        (10, "a" * 3000, "en", "a", 3000),
        (11, "one", "en", "d", 3),
    ]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)
    return rows.withColumns({"score": F.lit("x"), "fp": F.lit(1), "size": F.lit(2), "key": F.lit("k"), "row": F.lit(0), "word": F.lit("w")})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i == 7)) for i in range(1, 12)] + [(None, 1, 0), (2, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    for name, sql in queries.ORACLES.items():
        got = [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        want = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
        rows = lambda x: sorted([cell(r[c]) for c in sorted(r)] for r in x)
        assert rows(got) == rows(want), name


# 1


def plain_fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows):
    """rows: (id, fingerprint); component id by fingerprint."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[root(b)] = root(a)
    least = defaultdict(list)
    for d, f in rows:
        least[root(f)].append(d)
    return {f: min((d for d in least[root(f)] if d is not None), default=None) for f in fps}


def test_simhash_equals_brute_force(docs, texts, awkward):
    for got in (simhash.near_duplicates(docs).collect(), simhash.near_duplicates(awkward).collect()):
        want = plain_components([(r.doc_id, int(r.fingerprint, 16)) for r in got])
        assert all(r.component_id == want[int(r.fingerprint, 16)] for r in got)
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    assert all(int(got[d], 16) == plain_fingerprint(t) for d, t in texts.items())


def _in_gray_order(fps):
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return fps[np.argsort(rank)]


def _clusters(rng, n):
    centre = rng.integers(0, 1 << 63, 12, np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 6)).astype(np.uint64)) for _ in range(n)], np.uint64)
    return np.unique(centre[rng.integers(0, 12, n)] ^ flips)


@pytest.mark.parametrize("groups", [1, 7, 200])
def test_gray_index_finds_what_brute_force_finds(groups):
    rng = np.random.default_rng(groups)
    fps = _in_gray_order(_clusters(rng, 500))
    key = np.sort(rng.integers(0, groups, len(fps)))
    fps = np.concatenate([_in_gray_order(fps[key == k]) for k in range(groups)])
    searching = rng.random(len(fps)) < 0.7
    forest = simhash.GrayForest(simhash.starts_of(key), fps)
    pairs = [forest.search(some, np.arange(len(fps)), 4) for some in forest.chunks(np.flatnonzero(searching))]
    near = (np.bitwise_count(fps[:, None] ^ fps[None]) <= 4) & (key[:, None] == key[None]) & ~np.eye(len(fps), dtype=bool)
    a, b = np.nonzero(near & searching[:, None])
    assert {(x, y) for who, node in pairs for x, y in zip(who.tolist(), node.tolist(), strict=True)} == set(zip(a.tolist(), b.tolist(), strict=True))
    brute = simhash.Links(len(fps))
    brute.add(a, b)
    moved = np.flatnonzero(brute.label != np.arange(len(fps)))
    u, v = simhash.linked_within(key, fps, searching)
    assert (u == fps[moved]).all() and (v == fps[brute.label[moved]]).all() and len(moved)


def test_gray_index_prunes_groups():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 20, 20_000, np.uint64) << np.uint64(44)
    fps = _in_gray_order(np.unique(base | rng.integers(0, 4, 20_000, np.uint64)))
    forest = simhash.GrayForest(np.array([0]), fps)
    for some in forest.chunks(np.arange(len(fps))):
        forest.search(some, np.arange(len(fps)), 2)
    assert 0 < forest.visits < len(fps) ** 2 / 8


def test_patterns_in_blocks_lose_no_link(spark, monkeypatch):
    fps = _clusters(np.random.default_rng(8), 400)
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    whole = {(r.node, r.root) for r in components(simhash.near_links(table)).collect()}
    brute = plain_components([(i, int(f)) for i, f in enumerate(fps.tolist())])
    linked = {n for n, _ in whole}
    assert whole and len({r for _, r in whole}) + len(fps) - len(linked) == len(set(brute.values()))
    monkeypatch.setattr(simhash, "BLOCK", 9)
    assert {(r.node, r.root) for r in components(simhash.near_links(table)).collect()} == whole


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(roots[i] == 0 for i in range(61)) and all(roots[i] == 100 for i in range(100, 130)) and len(roots) == 91


# 2


def test_language_model_counts_and_beats_its_base(spark, docs, texts, awkward):
    got = lm_scoring.score_documents(docs).collect()
    split = {d: [*words(t.translate(LOWER)), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    c = Counter(w for d, s in split.items() if not held[d] for w in s)
    n, v = sum(c.values()), len(c)
    for r in got:
        s = split[r.doc_id]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(s), sum(c[w] > 0 for w in s), n)
        assert abs(r.base_score - base) < 1e-6
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    rows = lm_scoring.score_documents(awkward).collect()
    assert len(rows) == 13 and {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert len({round(r.score, 3) for r in rows if r.doc_id == 8}) == 1 and next(r for r in rows if r.doc_id is None).held_out


def test_network_is_a_distribution_and_its_gradient_is_right():
    layout = recurrent.Layout(3, 2)
    counts = np.array([5, 4, 3, 2, 6.0])
    weights = recurrent.initial(layout, counts)
    rng = np.random.default_rng(0)
    for k in ("c", "o"):
        weights[k] = (0.5 * rng.standard_normal(weights[k].shape)).astype(np.float32)
    nexts = [recurrent.score(weights, layout, [np.array([2, 1, w], np.int32)], 0)[0] - recurrent.score(weights, layout, [np.array([2, 1], np.int32)], 0)[0] for w in range(1, 5)]
    end = recurrent.score(weights, layout, [np.array([2, 1], np.int32)], 0)[0]
    begun = [recurrent.score(weights, layout, [np.array([2, 1], np.int32), np.array([2, 1], np.int32)], 0, 1)]
    assert abs(begun[0][0] - begun[0][1]) < 1e-4 and abs(begun[0][0] - end) < 1e-4 and all(np.isfinite(nexts))
    doc = [np.array([1, 2, 3, 4, 1, 2], np.int32)]
    trainer = recurrent.Trainer(weights, layout, 0.05)
    before = recurrent.score(trainer.p, layout, doc, 0)[0]
    for _ in range(30):
        trainer.learn(doc, 0)
    assert recurrent.score(trainer.p, layout, doc, 0)[0] > before + 1
    one = recurrent.score(weights, layout, [np.array([], np.int32)], 0)[0]
    firsts = [np.exp(recurrent.score(weights, layout, [np.array([w], np.int32)], 0)[0]) for w in range(1, 5)]
    assert np.exp(one) + sum(firsts) < 1.0001  # each first word's text is one of its continuations


def plain_log_probability(p, layout, doc, end):
    """One word after the other, from the equations of the gated unit, in double precision."""
    p = {k: v.astype(float) for k, v in p.items()}
    h, size, total, last = np.zeros(recurrent.HIDDEN), recurrent.HIDDEN, 0.0, layout.start
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for word in [*doc, end]:
        x, g = p["embedding"][last] @ p["w"] + p["b"], h @ p["u"]
        z, r = sigmoid(x[:size] + g[:size]), sigmoid(x[size : 2 * size] + g[size : 2 * size])
        n = np.tanh(x[2 * size :] + r * g[2 * size :])
        h = (1 - z) * n + z * h
        c = int(layout.classes(np.array([word]))[0])
        total += np.log(softmax(h @ p["c"] + p["cb"])[c])
        if word < layout.n_frequent:
            span = slice(c * recurrent.CLASS_WORDS, (c + 1) * recurrent.CLASS_WORDS)
            total += np.log(softmax(h @ p["o"][:, span] + p["ob"][span])[word - span.start])
        last = word
    return total


def _random_network(seed, frequent=70, rare=5, kind=np.float64):
    layout, rng = recurrent.Layout(frequent, rare), np.random.default_rng(seed)
    weights = recurrent.initial(layout, rng.integers(1, 50, frequent + rare).astype(float))
    real = weights["ob"] > -29
    weights = {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(kind) for k, v in weights.items()}
    weights["ob"][~real] = -30
    return layout, weights, rng


def test_scores_of_whole_documents_equal_a_plain_forward_pass():
    layout, weights, rng = _random_network(1, kind=np.float32)
    docs = [rng.integers(1, 75, n).astype(np.int32) for n in (0, 1, 5, 23, 24, 25, 130)]
    want = np.array([plain_log_probability(weights, layout, d.tolist(), 0) for d in docs])
    for most in (1, 3, 512):
        assert np.allclose(recurrent.score(weights, layout, docs, 0, most), want, rtol=1e-4, atol=1e-3)
    # The probabilities of all words and the end after a text add up to one.
    begun = [3, 4]
    ended = plain_log_probability(weights, layout, begun, 0)
    alone = plain_log_probability(weights, layout, begun[:-1], begun[-1])
    nexts = [plain_log_probability(weights, layout, begun, w) for w in range(75)]
    assert nexts[0] == ended and abs(np.exp(np.array(nexts) - alone).sum() - 1) < 1e-9


def test_gradient_equals_differences():
    layout, weights, rng = _random_network(2)
    docs = [rng.integers(1, 75, n).astype(np.int32) for n in (4, 9, 2)]
    inputs, targets, owner = recurrent.lanes(docs, layout, 0, 2)
    trainer = recurrent.Trainer(weights, layout, 0.01)
    h = np.zeros((inputs.shape[1], recurrent.HIDDEN))
    gradient, words_of, _ = trainer.gradient(inputs, targets, owner, h)
    loss = lambda p: -sum(plain_log_probability(p, layout, d.tolist(), 0) for d in docs)
    assert words_of == sum(len(d) + 1 for d in docs)
    for name, values in weights.items():
        for at in rng.choice(values.size, 6, replace=False):
            moved = [{**weights, name: values.copy()} for _ in range(2)]
            for m, by in zip(moved, (1e-5, -1e-5), strict=True):
                m[name].flat[at] += by
            slope = (loss(moved[0]) - loss(moved[1])) / 2e-5
            assert abs(slope - gradient[name].flat[at]) < 1e-3 * max(1, abs(slope)), (name, at)


def test_network_does_not_depend_on_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "DOCUMENTS", 40)
    narrow = docs.select("doc_id", "text")
    vocab = lm_scoring.vocabulary(narrow, lm_scoring.count_words(narrow))
    one, other = (lm_scoring.train(narrow.repartition(n), vocab) for n in (1, 7))
    assert all((one[k] == other[k]).all() for k in one)


def test_state_is_carried_across_windows():
    layout = recurrent.Layout(4, 1)
    weights = recurrent.initial(layout, np.ones(5))
    weights["c"] = np.random.default_rng(1).standard_normal(weights["c"].shape).astype(np.float32)
    doc = np.random.default_rng(2).integers(1, 5, 3 * recurrent.WINDOW + 5).astype(np.int32)
    whole = recurrent.score(weights, layout, [doc], 0)[0]
    recurrent_window = recurrent.WINDOW
    try:
        recurrent.WINDOW = 1000
        assert abs(recurrent.score(weights, layout, [doc], 0)[0] - whole) < 1e-2
    finally:
        recurrent.WINDOW = recurrent_window


# 3


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 50, 1000, 100000]) * rng.randint(1, 9) for i in range(rng.randint(1, 9))} | {None: 7}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got.keys() == sizes.keys() and all(abs(got[s] - t) < 1e-6 for s, t in plain_targets(sizes).items())


def test_mix_takes_each_target(awkward, docs):
    for table in (awkward, docs):
        rows = mixing.mix_sources(table).collect()
        taken, target = Counter(), {}
        for r in rows:
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert 0 <= r.taken <= 3 * r.size
        assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
        mixed = mixing.mixed_documents(table)
        assert mixed.columns == table.columns
        assert Counter(r.source for r in mixed.collect() for _ in words(r.text)) == +taken


# 4


def test_fingerprints_estimate_likeness(spark, awkward):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, near = [], []
    for i in range(12):
        a = [rng.choice(vocabulary) for _ in range(400)]
        b = a[: 40 * i] + [rng.choice(vocabulary) for _ in range(400 - 40 * i)] if i < 11 else a
        rows.append((" ".join(a), " ".join(b)))
        shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        near.append(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)))
    pairs = spark.createDataFrame(rows, "a string, b string").select("a", fingerprints.fingerprint(F.col("a")).alias("x"), fingerprints.fingerprint(F.col("b")).alias("y"))
    got = {r.a: r.near for r in pairs.select("a", fingerprints.likeness(F.col("x"), F.col("y")).alias("near")).collect()}
    assert all(abs(got[a] - want) < 0.15 for (a, _), want in zip(rows, near, strict=True)) and got[rows[11][0]] == 1.0
    out = fingerprints.edited_fingerprints(awkward).collect()
    assert len(out) == 13
    ordered = sorted({(r[0] if r[0] is not None else 1 << 63, hashlib.md5((r[1] or "").encode()).hexdigest(), r[1] or "") for r in awkward_rows()})
    edited = {}
    for (d, _, t), (_, _, n) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(t) // 2
        edited[None if d == 1 << 63 else d] = hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
    assert {r.doc_id: r.edited_sha256 for r in out} == edited
    assert {r.fingerprint for r in out if r.doc_id in (3, 4, 5)} == {""} and len({r.fingerprint for r in out if r.doc_id == 8}) == 1


# 5 and 10


def _auc(scores, label):
    order = np.argsort(np.argsort(scores))
    good = order[label == 1]
    return (good.sum() - len(good) * (len(good) - 1) / 2) / (len(good) * (label == 0).sum())


def _labelled(sf, column, modulus, remainder):
    rows = duckdb.sql(f"SELECT d.doc_id, text, {column}, lang FROM '{sf}/documents.parquet' d JOIN '{sf}/labels.parquet' USING (doc_id) ORDER BY md5(d.doc_id::VARCHAR)").fetchall()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % modulus == remainder]
    return [r for r in rows if r not in held], held


def test_quality_on_held_out_labels():
    train, held = _labelled("/root/testdata/sf0.01", "quality", 4, 2)
    model = quality.fit([r[1] for r in train], np.array([r[2] for r in train]), Counter(r[2] for r in train))
    scores = model.scores([r[1] for r in held], quality.Featuriser())
    assert _auc(scores, np.array([r[2] for r in held])) > 0.95


def test_toxicity_on_held_out_labels():
    train, held = _labelled("/root/testdata/sf0.01", "toxic", 5, 0)
    model = toxicity.fit([r[1] for r in train], [r[3] for r in train], np.array([r[2] for r in train]), Counter(r[2] for r in train))
    assert _auc(model.scores([r[1] for r in held]), np.array([r[2] for r in held])) > 0.7


def test_classifiers_on_awkward_rows(spark, awkward, labels):
    for score, unlabelled in ((quality.score_quality, 1.0), (toxicity.score_toxicity, 0.0)):
        rows = score(awkward, labels).collect()
        assert len(rows) == 13 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert next(r for r in rows if r.doc_id is None).held_out and len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
        assert {r.score for r in score(awkward, labels.limit(0)).collect()} == {unlabelled}
    assert quality.good_documents(awkward, labels).columns == awkward.columns


def test_sample_has_no_held_out_rows(docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample, counts = labelled.labelled_sample(docs, labels, "quality", 4, 2, 10)
    rows = sample.collect()
    assert len(rows) <= 20 and not any(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows) and sum(counts.values()) > 20


# 6


def plain_repeats(texts, least):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if count[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, awkward):
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice(["alpha", "beta", "γάμμα", "delta"]) + str(rng.randint(0, 99)) for _ in range(n))
    shared = [line(80) for _ in range(3)]
    made = [line(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 90) :] + line(rng.randint(0, 60)) for _ in range(40)]
    made += [made[0], made[1][:-3] + "xyz", line(40) * 5, "ab" * 700, ("Und " * 300) + line(30)]
    table = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(table).collect()}
    assert [got[i] for i in range(len(made))] == plain_repeats(made, 400)
    rows = repeats.remove_repeats(awkward).collect()
    want = Counter(zip([r[0] for r in awkward_rows()], plain_repeats([r[1] for r in awkward_rows()], 400), strict=True))
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in rows) == want


def _removed(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(table).collect()}
    return [got[i] for i in range(len(texts))]


def test_strings_whose_polynomial_hashes_collide_are_not_removed(spark):
    swap = str.maketrans("ab", "ba")
    x = "a"
    while len(x) < 256:
        x += x.translate(swap)
    y = x.translate(swap)
    rng = random.Random(11)
    anchor = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(128))
    texts = [x + anchor + y, y + anchor + x]
    got = _removed(spark, texts)
    assert got == plain_repeats(texts, 400) and all(r[1] == 0 for r in got)


def test_anchors_of_many_spans_are_narrowed(spark, monkeypatch):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    own = lambda n: "".join(rng.choice("klmnop ") for _ in range(n))
    texts = [own(rng.randint(0, 300)) + passage[rng.randint(0, 250) : rng.randint(350, 700)] + own(rng.randint(0, 300)) for _ in range(60)]
    texts += [own(40) + passage + own(40)] * 3
    want = plain_repeats(texts, 400)
    for block in (1 << 21, 30_000, 1500, 1):
        monkeypatch.setattr(repeats, "BLOCK", block)
        assert _removed(spark, texts) == want, block


def test_repeats_across_parts_of_long_texts(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef ") for _ in range(620_000))
    at = repeats.PART
    texts = [text, "x" * 500 + text[at - 700 : at + 900], "y" * 900, text[1000:1399], text[at - 200 : at + 199]]
    assert len({text[i : i + 400] for i in range(0, len(text) - 399, 7)}) == len(range(0, len(text) - 399, 7))
    got = _removed(spark, texts)
    assert got[0][1:3] == (1600, 1) and got[0][3] == hashlib.sha256((text[: at - 700] + text[at + 900 :]).encode()).hexdigest()
    assert got[1][1:3] == (2100, 1) and got[2][1] == 900 and got[3][1] == got[4][1] == 0


@settings(max_examples=150, deadline=None)
@given(strings=st.lists(st.binary(min_size=1, max_size=40) | st.text("ab", min_size=1, max_size=40).map(str.encode), min_size=1, max_size=6), least=st.integers(1, 25))
def test_interval_expansion_finds_what_occurs_twice(strings, least):
    count = Counter(s[i : i + least] for s in strings for i in range(len(s) - least + 1))
    got = transform.repeated_windows([np.frombuffer(s, np.uint8) for s in strings], least)
    assert [g.tolist() for g in got] == [[count[s[i : i + least]] > 1 for i in range(len(s) - least + 1)] for s in strings]


# 7


@pytest.fixture(scope="module")
def tokens():
    return packing.TokenBytes(queries.tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("ab'sé1 \n\t.,!?#漢\xa0 Zt²")), max_size=40))
def test_tokens_are_those_of_the_library(tokens, text):
    assert np.frombuffer(tokens(text), "<u4").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


def test_tokens_of_whole_documents_are_those_of_the_library(tokens, texts):
    rng = random.Random(8)
    sign = lambda w: w + "".join(rng.choice(packing._ENDINGS + "'") for _ in range(rng.randint(0, 3)))
    whole = [*texts.values(), *(" ".join(map(sign, t.split(" "))) for t in list(texts.values())[:60]), "", " ", "\n", "a ", " a", "a\n", "\na b", *(r[1] or "" for r in awkward_rows())]
    for text, ids in zip(whole, tokens.block(whole), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(lengths=st.lists(st.integers(1, 60), max_size=12), capacity=st.integers(0, 64))
def test_best_fill_is_the_best(lengths, capacity):
    counts = Counter(lengths)
    fill, used = packing.best_fill(dict(counts), sorted(counts), capacity)
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums}
    assert fill == max(s for s in sums if s <= capacity) == sum(n * k for n, k in used.items()) and all(k <= counts[n] for n, k in used.items())


def test_packing_round_trip(docs, texts, awkward, tokens):
    for table, source in ((docs, texts), (awkward, None)):
        rows = packing.pack_documents(table, queries.tokenizer_path()).collect()
        sequences = defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at == 1024 or at & (at - 1) == 0
        if source is not None:
            for d, t in source.items():
                ids = tokens(t) + packing.END
                mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
                assert [r.start for r in mine] == [sum(x.length for x in mine[:i]) for i in range(len(mine))]
                assert sum(r.length for r in mine) * 4 == len(ids) and all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in mine)
        else:
            assert sum(r.doc_tokens for r in rows if r.start == 0 and r.doc_id in (3, 4)) == 2


# 8


def test_exact_duplicates_of_awkward_rows(awkward):
    rows = {}
    for r in exact_dedup.exact_duplicates(awkward).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert rows[1][0].keep_id == 2 and not rows[1][0].kept and rows[2][0].kept and rows[1][0].group_size == 2
    assert rows[4][0].keep_id == 5 and rows[3][0].group_size == 3 and sorted(r.kept for r in rows[8]) == [False, True]
    assert rows[None][0].kept and sum(map(len, rows.values())) == 13
    kept = exact_dedup.drop_exact_duplicates(awkward)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 5, 6, 7, 8, 9, 10, 11] and kept.columns == awkward.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.integers(0, 2), st.integers(0, 2), st.integers(0, 9)), max_size=60), st.integers(1, 20))
def test_merge_of_sorted_rows_over_batches(rows, step):
    rows = sorted(rows)
    schema = pa.schema([pa.field(n, pa.int64(), nullable=False) for n in ("run", *exact_dedup.IDENTITY, "row", "group_size")])
    table = [pa.RecordBatch.from_pylist([dict(zip(schema.names, (*r, 1), strict=True)) for r in rows[a : a + step]], schema) for a in range(0, len(rows), step)]
    got = [tuple(r.values()) for b in exact_dedup.merge_sorted(iter(table)) for r in b.to_pylist()]
    first = {r[:4]: r for r in reversed(rows)}
    assert got == [(*first[k], n) for k, n in Counter(r[:4] for r in rows).items()]


def test_runs_merge_in_rounds(spark, monkeypatch):
    rng = random.Random(12)
    texts = ["hot" if rng.random() < 0.4 else f"t{rng.randint(0, 400)}" + " " * rng.randint(0, 3) for _ in range(1500)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    rounds = []
    plain = exact_dedup._merged
    monkeypatch.setattr(exact_dedup, "_merged", lambda rows: rounds.append(plain(rows)) or rounds[-1])
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t.strip()].append((-len(t), i))
    for fan_in, n in ((8, 2), (2, 6), (3, 4)):
        rounds.clear()
        monkeypatch.setattr(exact_dedup.merge_runs, "__defaults__", (fan_in,))
        got = exact_dedup.exact_duplicates(table).collect()
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, min(g)[1], len(g), (x, i) == min(g)) for g in groups.values() for x, i in g}
        assert len(rounds) == n + 1
        last = rounds[-1].groupBy(*exact_dedup.IDENTITY).count()
        assert last.where("count > 1").count() == 0 and last.count() == len(groups)
        one_run = rounds[0].groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("digest").alias("d")).collect()
        assert all(r.n == r.d for r in one_run)


# 9


def test_shards_are_even_and_keep_groups(spark, awkward):
    rows = [(i, f"text {i if i % 3 else i % 30}", None, None, None) for i in range(400)] + [(i, "hot", None, None, None) for i in range(400, 600)]
    for table, n, shards in ((spark.createDataFrame(rows, SCHEMA).repartition(4), 600, 4), (awkward, 13, 8)):
        got = sharding.shard_documents(table, shards).collect()
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert len(got) == n and all(sorted(s) == list(range(len(s))) for s in by.values())
        assert max(map(len, by.values())) - min(len(by[s]) for s in range(shards)) <= 1
    together = defaultdict(set)
    for r in sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 4).collect():
        together[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in together.values()) <= 3


# all


def test_empty_tables(spark, labels):
    none = spark.createDataFrame([], SCHEMA)
    path = queries.tokenizer_path()
    for result in (
        simhash.near_duplicates(none), lm_scoring.score_documents(none), mixing.mix_sources(none), mixing.mixed_documents(none),
        fingerprints.edited_fingerprints(none), quality.score_quality(none, labels), repeats.remove_repeats(none), packing.pack_documents(none, path),
        exact_dedup.exact_duplicates(none), sharding.shard_documents(none), toxicity.score_toxicity(none, labels), near_copies.drop_near_copies(none),
        exact_dedup.drop_exact_duplicates(none), quality.good_documents(none, labels),
    ):
        assert result.count() == 0


def test_pipeline_equals_plain_python(spark, texts, tokens):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after, state = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, SF)
        assert state.columns == docs.columns
        state = spark.createDataFrame(state.collect(), docs.schema)
        after[name] = state.collect()
    scored = {r.doc_id: r.predicted for r in quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in after["quality"]} == {d for d, p in scored.items() if p}
    groups = defaultdict(list)
    for r in after["quality"]:
        groups["".join(words(r.text))].append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in after["exact_dedup"]} == {min(g)[1] for g in groups.values()}
    shingles = {r.doc_id: {tuple(w[i : i + 5]) for w in [words(r.text.lower())] for i in range(max(1, len(w) - 4))} for r in after["exact_dedup"]}
    root = {d: d for d in shingles}
    for a, b in combinations(shingles, 2):
        if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]):
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    assert {r.doc_id for r in after["near_dedup"]} == {d for d, r in root.items() if d == r}
    sizes = Counter()
    for r in after["near_dedup"]:
        sizes[r.source] += len(words(r.text))
    mixed = Counter()
    for r in after["mix"]:
        mixed[r.source] += len(words(r.text))
    assert all(abs(mixed[s] - t) <= 0.5 for s, t in plain_targets(sizes).items())
    packed = corpus_pipeline.STAGES[-1][1](spark, state, SF).collect()
    assert sum(r.length for r in packed) == sum(len(tokens(r.text)) // 4 + 1 for r in after["mix"])
