"""Alignment of two tokenizers' tokens by the byte places where both end.

Python tokenises and does nothing else. It gives one row for each block of texts: the distinct pieces
of the block (a blank or line ends and what follows up to the next; no token of either tokenizer
reaches over that border) as the ends and ids of their tokens, and of each text the places of its pieces. From
there on all is array functions: the ends that both have cut the tokens of a piece into groups, a
group's tokens are linked, and a text's groups are those of its pieces. So each distinct piece of a
block is aligned once, however often it occurs.

A linked pair of ids is one number with the times that it occurs in its group in the high bits. How
many documents hold a pair is counted over the distinct pairs of each document; partial counts leave
few rows to shuffle. The counts meet the links again by broadcast while they are few, which is
checked, and by a shuffled join of each document's distinct pairs beyond that.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townlake.llm.common import stored

#: Bits of a token id; ids must be below 2**ID_BITS - 1. Two ids and the times of a pair share 64 bits.
ID_BITS = 17
#: Bytes of texts that are tokenised, and whose pieces are aligned, together.
BLOCK = 2 << 20
#: Pieces whose tokens a Python worker remembers, and the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 100_000, 64
#: New pieces that the libraries are asked for in one call.
TOGETHER = 500
#: Pairs of ids up to which their counts are broadcast.
MOST_BROADCAST = 2_000_000

#: Line ends begin pieces of their own, as a blank does.
_LINES = re.compile(r"\n+")
#: A text with a blank beside other white space, or any at its start, is one piece.
_UNUSUAL = re.compile(r"^\s| $| \s|\s ")


def byte_level_table() -> dict[str, int]:
    """The byte of each sign of a byte-level vocabulary: visible bytes stand for themselves, others follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Tokens:
    """The ends and ids of both tokenizers' tokens for pieces of text, a blank before each."""

    _made: dict[tuple[str, str], Tokens] = {}

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        signs = byte_level_table()
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        # An added token need not be written in the signs of bytes.
        self.a_bytes = [bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode() for t in (entries.get(i, "") for i in range(max(entries) + 1))]
        self.b_bytes = [self._of_piece(i) for i in range(self.b.get_piece_size())]
        if max(len(self.a_bytes), len(self.b_bytes)) >= (1 << ID_BITS):
            raise ValueError(f"token ids take more than {ID_BITS} bits")
        # Words can be tokenised alone only where no token holds a blank after another sign, white space aside.
        self.by_word = not any(t.decode("utf-8", "replace").strip() and b" " in t.lstrip(b" ") for t in (*self.a_bytes, *self.b_bytes))
        self.a_lengths, self.b_lengths = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        #: Tokens by piece; what is asked for again moves from the older ones to the others before those are dropped.
        self.known: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Tokens:
        if (a_path, b_path) not in cls._made:
            cls._made[a_path, b_path] = cls(a_path, b_path)
        return cls._made[a_path, b_path]

    def _of_piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ask(self, pieces: list[str]) -> list[bytes | None]:
        """The token numbers of each piece, A's and then B's; the libraries are asked for new ones only, many at a time.

        None for a piece that the bytes of either side's tokens do not give back.
        """
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, new = self.known, []
        for p in pieces:
            if p not in known:
                if p in self.older:
                    known[p] = self.older[p]
                else:
                    new.append(p)
        long, found = [p for p in new if len(p) > LONGEST_REMEMBERED], {}
        for some, into in ((long, found), ([p for p in new if len(p) <= LONGEST_REMEMBERED], known)):
            for k in range(0, len(some), TOGETHER):
                part = some[k : k + TOGETHER]
                # None: there is a piece among them whose bytes differ.
                into.update(zip(part, self._together(part) or [(self._together([p]) or [None])[0] for p in part], strict=True))
        return [known[p] if p in known else found[p] for p in pieces]

    def whole(self, text: str) -> bytes | None:
        """The token numbers of a text that is one piece."""
        surface = " " + text
        found = self._numbers(surface, np.array([0, len(surface.encode("utf-8", "surrogatepass"))]))
        return found[0] if found else None

    def _together(self, pieces: list[str]) -> list[bytes] | None:
        """The token numbers of pieces that are asked for as one text, after a word of no use."""
        surfaces = [" a", *(p if p[:1] == "\n" else " " + p for p in pieces)]
        bounds = np.cumsum([0, *(len(x.encode("utf-8", "surrogatepass")) for x in surfaces)])
        found = self._numbers("".join(surfaces), bounds)
        return found and found[1:]

    def _numbers(self, surface: str, bounds: np.ndarray) -> list[bytes] | None:
        """Token numbers of what lies between the byte places ``bounds``; None if bytes differ or a token lies over one."""
        expected, sides = surface.encode("utf-8", "surrogatepass"), []
        for of_b, (ids, table, lengths) in enumerate((
            (self.a.encode_batch_fast([surface], add_special_tokens=False)[0].ids, self.a_bytes, self.a_lengths),
            (self.b.encode(surface[1:]), self.b_bytes, self.b_lengths),
        )):
            if b"".join(map(table.__getitem__, ids)) != expected:
                return None
            ids = np.array(ids, np.int64)
            ends = np.cumsum(lengths[ids])
            cuts = np.searchsorted(ends, bounds[1:])
            if (ends[cuts] != bounds[1:]).any():
                return None
            at = np.r_[0, cuts + 1]
            numbers = token_number(ends - np.repeat(bounds[:-1], np.diff(at)), of_b, ids).tobytes()
            sides.append([numbers[i:j] for i, j in zip((8 * at).tolist(), (8 * at[1:]).tolist(), strict=False)])
        return [a + b for a, b in zip(*sides, strict=True)]


def token_number(end: np.ndarray, of_b: int, ids: np.ndarray) -> np.ndarray:
    return (end << (ID_BITS + 1)) | (of_b << ID_BITS) | ids


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def tokenised_block(ids: pa.Array, texts: list[str], tokens: Tokens) -> pa.RecordBatch:
    """One row: ``pieces`` of a block of texts, and ``texts`` with their ids and the places of their pieces."""
    whole = [not tokens.by_word or bool(_UNUSUAL.search(t)) for t in texts]
    parted = [_LINES.sub(r" \g<0>", t) if not w and "\n" in t else "" if w else t for t, w in zip(texts, whole, strict=True)]
    words = pc.split_pattern(pa.array(parted, pa.large_string()), " ")
    coded = words.values.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    found = tokens.ask(distinct) + [tokens.whole(t) for t, w in zip(texts, whole, strict=True) if w]
    index, offsets = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), words.offsets.to_numpy()
    wrong = np.array([x is None for x in found], bool)
    flat = np.frombuffer(b"".join([x or b"" for x in found]), np.int64)
    sizes = np.array([len(x or b"") for x in found], np.int64) // 8
    of_b = (flat >> ID_BITS & 1).astype(bool)
    before = np.r_[0, np.cumsum(of_b)][np.r_[0, np.cumsum(sizes)]]
    b_sizes = np.diff(before)
    a_sizes = sizes - b_sizes
    places, later = [], len(distinct)
    for k, (text, w) in enumerate(zip(texts, whole, strict=True)):
        if w:
            of_text, later = np.array([later], np.int32), later + 1
        else:
            of_text = index[offsets[k] : offsets[k + 1]]
        places.append(np.zeros(0, np.int32) if not text or wrong[of_text].any() else of_text)
    counts = [pa.array([int(n[p].sum()) for p in places], pa.int64()) for n in (a_sizes, b_sizes)]
    of_texts = _lists(np.concatenate(places), np.array(list(map(len, places)), np.int64))
    ends = flat >> (ID_BITS + 1)
    parts = [_lists(flat, sizes), _lists(ends[~of_b], a_sizes), _lists(ends[of_b], b_sizes)]
    row = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    pieces = pa.StructArray.from_arrays(parts, ["tokens", "a_ends", "b_ends"])
    return pa.RecordBatch.from_arrays([row(pieces), row(pa.StructArray.from_arrays([ids, *counts, of_texts], ["doc_id", "n_a", "n_b", "places"]))], ["pieces", "texts"])


def tokenised(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Blocks of texts as ``pieces`` and ``texts``; the texts have (doc_id, n_a, n_b, places)."""
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(a_path, b_path)
        for batch in batches:
            size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            block = (np.cumsum(size) - size) // BLOCK
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist() if len(batch) else []
            for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
                part = batch.slice(a, b - a)
                yield tokenised_block(part.column(0), part.column(1).to_pylist(), tokens)

    kind = narrow.schema["doc_id"].dataType.simpleString()
    longs = "array<bigint>"
    schema = f"pieces array<struct<tokens: {longs}, a_ends: {longs}, b_ends: {longs}>>, texts array<struct<doc_id: {kind}, n_a: bigint, n_b: bigint, places: array<int>>>"
    return narrow.mapInArrow(blocks, schema)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, whatever number of times it is used."""
    return F.transform(F.array(value), use)[0]


ID_MASK = (1 << ID_BITS) - 1
#: The number of a group's end: after all tokens that end there, and no token's id.
MARK = (1 << (ID_BITS + 1)) - 1


def _id(token: Column) -> Column:
    return token.bitwiseAND(F.lit(ID_MASK).cast("long"))


def _once(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.lit(1 << (2 * ID_BITS)).cast("long").bitwiseOR(x))


def _times(ids: Column) -> Column:
    """The distinct ids of a list in their order, each with its times in the high bits."""
    count = lambda x: F.size(F.filter(ids, lambda y: y == x)).cast("long")
    counted = lambda found: F.transform(found, lambda x: F.shiftleft(count(x), 2 * ID_BITS).bitwiseOR(x))
    return _let(F.array_distinct(ids), lambda found: F.when(F.size(found) == F.size(ids), _once(ids)).otherwise(counted(found)))


def pair_number(a: Column, b: Column) -> Column:
    """The linked pair of two ids that come from ``_times``: the times multiply, the ids lie beside each other."""
    both = F.shiftright(a, 2 * ID_BITS) * F.shiftright(b, 2 * ID_BITS)
    return F.shiftleft(both, 2 * ID_BITS).bitwiseOR(F.shiftleft(_id(a), ID_BITS)).bitwiseOR(_id(b))


def _linked(a: Column, b: Column) -> Column:
    """The links of a group of one token of each side."""
    return F.lit(1 << (2 * ID_BITS)).cast("long").bitwiseOR(F.shiftleft(a, ID_BITS)).bitwiseOR(b)


def _group(tokens: Column) -> Column:
    """The text form and the links of one group, whose tokens are in the order of their ends."""
    of_b = F.lit(1 << ID_BITS).cast("long")

    def ids(side: Column) -> Column:
        return F.transform(F.filter(tokens, lambda t: t.bitwiseAND(of_b) == side), _id)

    def made(a: Column, b: Column) -> Column:
        text = F.concat(F.array_join(a.cast("array<string>"), ","), F.lit("|"), F.array_join(b.cast("array<string>"), ","))
        links = _let(_times(b), lambda right: F.flatten(F.transform(_times(a), lambda x: F.transform(right, lambda y: pair_number(x, y)))))
        return F.struct(text.alias("text"), links.alias("links"))

    return _let(ids(F.lit(0).cast("long")), lambda a: _let(ids(of_b), lambda b: made(a, b)))


def _single(a: Column, b: Column) -> Column:
    """``_group`` of one token of each side, as most groups are."""
    return F.struct(F.concat(a.cast("string"), F.lit("|"), b.cast("string")).alias("text"), F.array(_linked(a, b)).alias("links"))


def _one_to_one(piece: Column) -> Column:
    """The groups of a piece of which each token of A ends where one of B ends."""
    n = F.size(piece["a_ends"])
    links = F.zip_with(F.slice(piece["tokens"], 1, n), F.slice(piece["tokens"], n + 1, n), lambda a, b: _linked(_id(a), _id(b)))
    form = lambda x: F.concat(_id(F.shiftright(x, ID_BITS)).cast("string"), F.lit("|"), _id(x).cast("string"))
    return _let(links, lambda links: F.struct(n.cast("long").alias("n"), F.array_join(F.transform(links, form), ";").alias("text"), links.alias("links")))


def _aligned(piece: Column) -> Column:
    """The groups of a piece: how many, their text form and their links.

    The ends that both have, as numbers that follow all tokens which end there, are sorted among the
    tokens: what lies between two of them is a group.
    """
    is_mark = lambda t: t.bitwiseAND(F.lit(MARK).cast("long")) == MARK

    def groups(sorted_: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(sorted_)), lambda k: is_mark(sorted_[k - 1]))

        def group(end: Column, last: Column) -> Column:
            single = _single(_id(sorted_[end - 3]), _id(sorted_[end - 2]))
            return F.when(end - last == 3, single).otherwise(_group(F.slice(sorted_, last + 1, end - last - 1)))

        return _let(at, lambda at: F.transform(at, lambda end, g: group(end, F.when(g == 0, 0).otherwise(at[g - 1]))))

    def whole(groups: Column) -> Column:
        text = F.array_join(F.transform(groups, lambda g: g["text"]), ";")
        return F.struct(F.size(groups).cast("long").alias("n"), text.alias("text"), F.flatten(F.transform(groups, lambda g: g["links"])).alias("links"))

    def of(common: Column) -> Column:
        marks = F.transform(common, lambda e: F.shiftleft(e, ID_BITS + 1).bitwiseOR(F.lit(MARK).cast("long")))
        both = (F.size(common) == F.size(piece["a_ends"])) & (F.size(common) == F.size(piece["b_ends"]))
        mixed = _let(_let(F.sort_array(F.concat(piece["tokens"], marks)), groups), whole)
        # A piece whose bytes differ has no tokens, and no text has it.
        return F.when(both, _one_to_one(piece)).when(F.size(common) > 0, mixed)

    return _let(F.array_intersect(piece["a_ends"], piece["b_ends"]), of)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``) and links of every row of ``docs``.

    A takes a space and the text, B the text, before which it puts a space itself. ``links`` has a
    number for each distinct linked pair of ids of each group: the times that it occurs there, A's
    id and B's id. Null and empty texts, and texts whose tokens' bytes are not a space and the text,
    have no tokens: zeros, an empty ``groups``, no links. Strings of special tokens are plain text.
    Repeated rows are documents of their own, ids may be null or of any type; an empty table gives
    no rows, and other columns are not read.
    """
    blocks = tokenised(docs, a_path, b_path)

    def of_text(text: Column, pieces: Column) -> Column:
        def of_pieces(mine: Column) -> Column:
            n_groups = F.aggregate(mine["n"], F.lit(0).cast("long"), lambda s, n: s + n)
            return F.struct(
                text["doc_id"].alias("doc_id"), text["n_a"].alias("n_a"), text["n_b"].alias("n_b"), n_groups.alias("n_groups"),
                F.array_join(mine["text"], ";").alias("groups"), F.flatten(mine["links"]).alias("links"),
            )

        # A text's pieces are looked up once; what is taken of them are fields of that list.
        return _let(F.transform(text["places"], lambda k: pieces[k]), of_pieces)

    found = _let(F.transform("pieces", _aligned), lambda pieces: F.transform("texts", lambda t: of_text(t, pieces)))
    return blocks.select(F.inline(found))


def _pair(link: Column) -> Column:
    return link.bitwiseAND(F.lit((1 << (2 * ID_BITS)) - 1).cast("long"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, documents, best): how many documents hold each linked pair, and whether no pair of its A id is in more."""
    distinct = aligned.select(F.explode(F.array_distinct(F.transform("links", _pair))).alias("pair"))
    counts = stored(distinct.groupBy("pair").agg(F.count("*").alias("documents")), "pairs").withColumn("a", F.shiftright("pair", ID_BITS))
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def with_link_sums(rows: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Stored rows of ``align``, numbered by ``row``, with n_links, n_best and count_sum instead of both."""
    own = [c for c in rows.columns if c not in ("links", "row")]
    counts = stored(pair_counts(rows), "counts")
    links = rows.select("row", F.explode("links").alias("link")).select("row", _pair(F.col("link")).alias("pair"), F.shiftright("link", 2 * ID_BITS).alias("times"))
    if counts.count() <= most_broadcast:
        met = links.join(F.broadcast(counts), "pair")
    else:
        met = links.groupBy("row", "pair").agg(F.sum("times").alias("times")).join(counts, "pair")
    sums = met.groupBy("row").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("links").join(sums, "row", "left").select(*own, *map(zero, ("n_links", "n_best", "count_sum")))


def alignment_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row, as ``align`` and ``with_link_sums`` say."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    number = F.monotonically_increasing_id().alias("row")
    aligned = align(docs, a_path, b_path).select(number, "doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "links")
    return with_link_sums(stored(aligned, "aligned")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
