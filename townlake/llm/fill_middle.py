"""Fill-in-the-middle training texts by succinct rank and select.

The texts of an Arrow batch lie one after the other in one buffer of UTF-8. A packed bit vector
marks the bytes that begin a code point, and a directory holds the number of marks before every
block of it. The marks up to a text's end less those up to its start are its code points; selecting
two of its marks gives the bytes to cut at. No text is decoded, and none is cut by a loop over its
characters. Where to cut and in what order comes from a hash of the document's id alone, so a run
repeats itself on any partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The signs before a prefix, a suffix and a middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What is written before the id that is hashed.
SEED = 1
#: Of 100 texts so many stay plain, and of 100 others so many have their suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: 64-bit words of a block of the directory.
BLOCK_WORDS = 8


class Marks:
    """A packed bit vector over bytes that marks where code points begin, with rank and select."""

    def __init__(self, data: np.ndarray) -> None:
        begins = (data & 0xC0) != 0x80
        packed = np.packbits(begins, bitorder="little")
        span = 8 * BLOCK_WORDS
        self.words = np.concatenate([packed, np.zeros(-len(packed) % span + span, np.uint8)]).view("<u8")
        self.in_word = np.bitwise_count(self.words).astype(np.int64).reshape(-1, BLOCK_WORDS)
        #: Marks before each block; the last entry is the number of all.
        self.before = np.concatenate([[0], np.cumsum(self.in_word.sum(1))])
        #: Marks in a block before each of its words.
        self.in_block = np.cumsum(self.in_word, axis=1) - self.in_word

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bytes before each place begin a code point."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        block = word // BLOCK_WORDS
        return self.before[block] + self.in_block[block, word % BLOCK_WORDS] + np.bitwise_count(low)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The place of the mark that has each number of marks before it; it must be there."""
        block = np.searchsorted(self.before, ranks, "right") - 1
        left = ranks - self.before[block]
        inner = (self.in_block[block] <= left[:, None]).sum(1) - 1
        left = left - self.in_block[block, inner]
        word, bit = self.words[block * BLOCK_WORDS + inner], np.zeros(len(ranks), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = word & np.uint64((1 << width) - 1)
            count = np.bitwise_count(low).astype(np.int64)
            above = left >= count
            word = np.where(above, word >> np.uint64(width), low)
            left, bit = np.where(above, left - count, left), np.where(above, bit + width, bit)
        return (block * BLOCK_WORDS + inner) * 64 + bit


def cut_places(starts: np.ndarray, ends: np.ndarray, data: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, cuts): the code points of each text, and the first and the second cut as code points and as places.

    ``starts`` and ``ends`` are places of whole texts in ``data``; ``draws`` has two numbers a text.
    ``cuts`` has the rows first, second, place of the first, place of the second.
    """
    marks = Marks(data)
    first_mark, end_mark = marks.rank(starts), marks.rank(ends)
    n = end_mark - first_mark
    drawn = np.sort(draws % (n[:, None] + 1), axis=1)
    places = np.repeat(ends[:, None], 2, 1)
    inside = drawn < n[:, None]  # a cut after the last code point is the text's end
    places[inside] = marks.select((first_mark[:, None] + drawn)[inside])
    return n, np.stack([drawn[:, 0], drawn[:, 1], places[:, 0], places[:, 1]])


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of the seed, a colon and the id (null: nothing)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of ``docs``.

    n is the number of code points of the whole text (null: empty). The prefix ends at the smaller
    and the middle at the larger of two drawn places. The form is ``plain`` (the output is the text,
    the two counts are null) for an empty text, for one that has a sign in it, and for PLAIN of 100
    draws; else ``spm`` (suffix first) for SUFFIX_FIRST of 100 and ``psm`` for the rest. Rows with
    one id are drawn alike, rows without one too; repeated rows are rows. An empty table gives no
    rows, and other columns are not read.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    signs = [text.contains(x) for x in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.octet_length(text) == 0) | signs[0] | signs[1] | signs[2] | (h3 % 100 >= 100 - PLAIN)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    asked = docs.select("doc_id", text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    zero = F.lit(0).cast("long")
    shape = asked.select("doc_id", zero.alias("n"), "form", zero.alias("prefix_chars"), zero.alias("middle_chars"), F.lit("").alias("output")).schema
    for field in shape.fields:
        field.nullable = True

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            _, offsets, buffer = texts.buffers()
            ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(batch) + 1] if len(batch) else np.zeros(1, np.int64)
            data = np.frombuffer(buffer, np.uint8)[: ends[-1]] if buffer is not None else np.zeros(0, np.uint8)
            two = np.stack([batch.column(k).to_numpy() for k in (3, 4)], 1)
            n, (first, second, at, to) = cut_places(ends[:-1], ends[1:], data, two)
            forms, whole, out = batch.column(2).to_pylist(), memoryview(data), []
            for form, a, b, c, d in zip(forms, ends[:-1].tolist(), at.tolist(), to.tolist(), ends[1:].tolist(), strict=True):
                if form == "plain":
                    out.append(bytes(whole[a:d]))
                elif form == "psm":
                    out.append(b"".join([p, whole[a:b], s, whole[c:d], m, whole[b:c]]))
                else:
                    out.append(b"".join([s, whole[c:d], p, whole[a:b], m, whole[b:c]]))
            cut = np.array([x == "plain" for x in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), batch.column(2), pa.array(first, mask=cut), pa.array(second - first, mask=cut), pa.array(out, pa.binary()).view(pa.string())],
                shape.names,
            )

    return asked.mapInArrow(written, shape)


def _parts(output: Column, first: str, second: str) -> tuple[Column, Column, Column]:
    """What follows each of the three signs, the last of which is that of the middle."""
    rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
    one = F.substring_index(rest, second, 1)
    rest = F.substring(rest, F.length(one) + len(second) + 1, F.length(output))
    two = F.substring_index(rest, MIDDLE, 1)
    return one, two, F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(output))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, read from the output and its form alone.

    A text with a sign in it is plain, so the first sign of a kind is the one that was written.
    """
    prefix, suffix, middle = _parts(output, PREFIX, SUFFIX)
    late_suffix, late_prefix, late_middle = _parts(output, SUFFIX, PREFIX)
    rebuilt = F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, late_middle, late_suffix))
    return rebuilt.otherwise(output)


def fill_in_middle_digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``fill_in_middle`` with the SHA-256 of the output and of the text rebuilt from it, not the output itself."""
    made = fill_in_middle(docs, seed)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
