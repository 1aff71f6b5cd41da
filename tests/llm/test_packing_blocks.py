"""Packing takes texts some bytes at a time."""

from townlake.llm import packing, queries


def test_bytes_tokenised_together_change_no_packed_row(spark):
    """A worker that takes fewer texts at once needs less memory, and places the same pieces."""
    rows = [(i, f"text {i} " * (i % 50 + 1)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    path = queries.tokenizer_path()
    whole, few = (packing.pack_documents(docs, path, block=n).collect() for n in (1 << 22, 100))
    assert whole == few and {r.doc_id for r in few} == set(range(120))
    batch = docs.toArrow().to_batches()[0]
    assert max(sum(map(len, b.column(1).to_pylist())) for b in packing._blocks(batch, 1000)) < 2000
