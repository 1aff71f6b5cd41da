"""Fill-in-the-middle against slices of plain strings."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from townlake.llm import fill_middle

SCHEMA = "doc_id long, text string, form string, output string, h1 int"
LONG = "Straße ü𝄞 日本 " * 9000


def plain_output(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    a, b = sorted(x % (len(text) + 1) for x in h[:2])
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(text), "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows():
    texts = [None, "", "a", "ü", "日本語", "<P>", "a <S> b", "x<M", "<<P", "a<S", "S>b", "𝄞", "é\0", "<", LONG, LONG, "the cat sat on the mat", "\n\n"]
    return [(i, t, "x", "y", 1) for i, t in enumerate(texts * 6)] + [(7, texts[6], "x", "y", 1), (None, "no id here", None, None, None), (None, "nor here ü", "x", "y", 1)]


def test_outputs_equal_plain_slices(spark):
    given_rows = rows()
    table = spark.createDataFrame(given_rows, SCHEMA).repartition(3)
    made = fill_middle.fill_in_middle(table)
    both = made.withColumn("restored", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in both), key=key)
    want = sorted(((d, *plain_output(d, t), t or "") for d, t, *_ in given_rows), key=key)
    assert got == want
    assert {r.form for r in both} == {"plain", "psm", "spm"}


def test_empty_table_and_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fill_middle.fill_in_middle_digests(none).collect() == []
    assert fill_middle.fill_in_middle_digests(none).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_ids_of_another_type(spark):
    table = spark.createDataFrame([("k1", "some words"), ("k2", None)], "doc_id string, text string")
    got = {r.doc_id: r.output for r in fill_middle.fill_in_middle(table).collect()}
    assert got == {d: plain_output(d, t)[-1] for d, t in (("k1", "some words"), ("k2", None))}


@given(st.lists(st.text(max_size=300), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_rank_and_select_equal_counting(texts):
    data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    marks = fill_middle.Marks(data)
    places = np.arange(len(data) + 1)
    assert marks.rank(places).tolist() == [int((begins < p).sum()) for p in places]
    assert marks.select(np.arange(len(begins))).tolist() == begins.tolist()
    assert marks.before[-1] == len(begins)
