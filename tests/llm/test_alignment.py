"""Alignment against plain Python over whole texts and whole libraries."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from townlake.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row long, links string, pair int, pieces string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_tokens(libraries, text):
    """The ids and bytes of both sides for a whole text, or two empty lists."""
    a, b = libraries
    signs = alignment.byte_level_table()
    encoded = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in encoded.ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes.fromhex(piece[3:5]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    if not text or not b"".join(x for _, x in left) == b"".join(x for _, x in right) == (" " + text).encode():
        return [], []
    return left, right


def plain_groups(left, right):
    groups, a_end, b_end, a, b, right = [], 0, 0, [], [], list(right)
    for i, x in left:
        a.append(i)
        a_end += len(x)
        while b_end < a_end:
            j, y = right.pop(0)
            b.append(j)
            b_end += len(y)
        if a_end == b_end:
            groups.append((a, b))
            a, b = [], []
    return groups


def plain_rows(libraries, rows):
    aligned = [plain_groups(*plain_tokens(libraries, t or "")) for _, t in rows]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in aligned]
    documents = Counter(p for found in links for p in found)
    most = defaultdict(int)
    for (x, _), n in documents.items():
        most[x] = max(most[x], n)
    out = []
    for (d, _), groups, found in zip(rows, aligned, links, strict=True):
        form = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(n for p, n in found.items() if documents[p] == most[p[0]])
        total = sum(n * documents[p] for p, n in found.items())
        digest = hashlib.sha256(form.encode()).hexdigest() if groups else ""
        out.append((d, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), found.total(), best, total, digest))
    return out


def awkward():
    texts = [
        None, "", " ", "a", " a", "a ", "a  b", "a \n b", "x\n\ny z", "tab\tand more　here", "<|endoftext|> <s> </s> <unk> <0x41>",
        "▁q is a sign", "ﬁ Å é naïve Straße", "日本語 のテキスト 𝄞", "it's can't 12345 67.89", "=" * 700 + " " + "-" * 333, "a" * 3000, "\0 nul \x07 bell",
        "ends with line\n", "\nbegins with line", "Töpfe, “quoted” — dashes… and 👩‍👩‍👧 signs", "word " * 3000 + "end", "abc" * 400 + "\t" + "ab " * 500,
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (3, "a"), (3, "a"), (None, "no id here"), (None, "no id there")]


def table(spark, rows):
    return spark.createDataFrame([(d, t, 5, "x", 7, None) for d, t in rows], SCHEMA)


def gathered(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_awkward_rows_equal_plain_python(spark, libraries):
    rows = awkward()
    want = ordered(plain_rows(libraries, rows))
    assert gathered(alignment.alignment_digests(table(spark, rows).repartition(3), A, B)) == want
    assert sum(r[1] == 0 for r in want) >= 3  # null, empty and a sign that both cannot give back


def test_documents_equal_plain_python(spark, libraries):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = queries.QUERIES["op12_align"](spark, "/root/testdata/sf0.001")
    assert gathered(got) == ordered(plain_rows(libraries, rows))


def test_sums_are_the_same_beyond_what_is_broadcast(spark):
    from townlake.llm.common import stored

    rows = alignment.align(table(spark, awkward()), A, B).drop("groups").withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "aligned")
    few, many = (alignment.with_link_sums(rows, most) for most in (10**9, 0))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(few) == key(many)


def test_a_group_of_many_equal_tokens_has_few_links(spark, libraries):
    """Links are kept by distinct pair, so a group's rows do not grow with the product of its tokens."""
    text = "x" + "=" * 4000 + "-" * 3001
    row = alignment.align(table(spark, [(1, text)]), A, B).first()
    want = plain_groups(*plain_tokens(libraries, text))
    assert row.groups == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
    assert len(row.links) == sum(len(set(a)) * len(set(b)) for a, b in want)


def test_empty_table(spark):
    assert alignment.alignment_digests(table(spark, []), A, B).collect() == []


@given(st.lists(st.sampled_from(["the", "Hatten", " ", "  ", "\n", "\t", "é", "日", "'s", "12", ".", "-", "▁", "ing", " ", "<s>", "=", "THE"]), max_size=20).map("".join))
@settings(max_examples=300, deadline=None)
def test_tokens_by_piece_are_those_of_whole_texts(text):
    import pyarrow as pa

    tokens = alignment.Tokens.of(A, B)
    libraries = (tokens.a, tokens.b)
    left, right = plain_tokens(libraries, text)
    row = alignment.tokenised_block(pa.array([1]), [text], tokens).to_pylist()[0]
    of_text, got_a, got_b = row["texts"][0], [], []
    for k in of_text["places"]:
        for t in row["pieces"][k]["tokens"]:
            (got_b if t >> alignment.ID_BITS & 1 else got_a).append(t & alignment.ID_MASK)
    assert (got_a, got_b) == ([i for i, _ in left], [i for i, _ in right])
    assert (of_text["n_a"], of_text["n_b"]) == (len(left), len(right))


def test_a_text_looks_its_pieces_up_once(spark):
    docs = spark.createDataFrame([(1, "a few words")], "doc_id long, text string")
    found = alignment.align(docs, queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"))
    assert found._jdf.queryExecution().analyzed().toString().count(".places") == 1
