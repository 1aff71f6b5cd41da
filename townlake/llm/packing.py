"""Packing tokenised documents into sequences by minimum bin slack.

Each task tokenises its documents and packs them as they come. Whole windows of a long document
are sequences of their own. What remains of the documents waits in a pool of lengths; a window
takes the longest of them, and a subset-sum over a bitset of reachable fills picks the multiset of
other lengths that fills the window closest to its capacity. Slack that no choice fills is filled
by cutting a piece, and the last, partial window of a task is cut into powers of two, which need
no padding. No text or token leaves its task, so nothing is shuffled.
"""

from __future__ import annotations

import gc
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from townlake.llm.common import give_back_memory

CAPACITY = 1024
END = b"\0\0\0\0"
#: Chunks whose ids a Python worker remembers.
REMEMBERED = 500_000
#: Bytes of texts that are tokenised together.
BLOCK = 1 << 22
#: Waiting remainders from which on windows are packed; below, only the end of the input packs.
POOL = 2048

#: White space, as the tokenizer's pattern takes it, other than blanks and line ends.
_OTHER_SPACES = "\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: A text without any of these has single blanks and line ends only. No token of the tokenizer
#: reaches across those, but for the blank that begins a word's first token.
#: An apostrophe is not among them: it begins tokens like 's.
_ENDINGS = ".,;:!?*#$%&()[]|\""
_UNUSUAL = (*_OTHER_SPACES, "  ", " \n", "\n ", "\n\n")


class TokenBytes:
    """Token ids of texts as little-endian unsigned 32-bit numbers, by the ``tokenizers`` library.

    Texts are cut at blanks and line ends, where no token can reach across, and the ids of words
    are remembered. The library is asked once for each distinct word, for all new words of a block
    of texts in one call; a block's ids are then gathered from those of its distinct pieces.
    """

    _made: dict[tuple[str, int], TokenBytes] = {}

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end = self._encode("\n")
        self.fresh: list[dict[str, bytes]] = [{"": b""}, {"": self._encode(" ")}]
        self.known = [dict(x) for x in self.fresh]

    @classmethod
    def of(cls, path: str, remembered: int = REMEMBERED) -> TokenBytes:
        if (path, remembered) not in cls._made:
            cls._made[path, remembered] = cls(path, remembered)
        return cls._made[path, remembered]

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        return self.block([text])[0]

    def _unusual(self, text: str) -> bool:
        return any(x in text for x in self.special) or any(x in text for x in _UNUSUAL)

    def block(self, texts: list[str]) -> list[bytes]:
        """The ids of each of some texts; those with unusual white space are asked for whole."""
        odd = [self._unusual(t) for t in texts] if self._unusual("\0".join(texts)) else [False] * len(texts)
        # A line end before each text marks its first word, which has no blank before it.
        marked = pa.array(["\n" if o else "\n" + t for o, t in zip(odd, texts, strict=True)], pa.large_string())
        pieces = pc.split_pattern(marked, " ")
        coded = pieces.values.dictionary_encode()
        collecting = gc.isenabled()
        gc.disable()  # many strings, no cycles
        distinct = self._of_pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        if collecting:
            gc.enable()
        sizes = np.array([len(x) for x in distinct]) // 4
        starts, index = np.cumsum(sizes) - sizes, coded.indices.to_numpy(zero_copy_only=False)
        taken = sizes[index]
        ends = np.cumsum(taken)
        flat = np.frombuffer(b"".join(distinct), "<u4")
        ids = flat[np.repeat(starts[index] - (ends - taken), taken) + np.arange(int(taken.sum()))].tobytes()
        bounds = (4 * np.r_[0, ends])[pieces.offsets.to_numpy()].tolist()
        return [self._encode(t) if o else ids[a:b] for o, t, a, b in zip(odd, texts, bounds, bounds[1:], strict=False)]

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces between blanks: a word, or lines' last and first words, or a text's first."""
        for held, fresh in zip(self.known, self.fresh, strict=True):
            if len(held) > self.remembered:
                held.clear()
                held.update(fresh)
        bare, after_blank = self.known
        new = [p for p in pieces if p not in after_blank]
        lined = [p for p in new if "\n" in p]
        first_of_text = [p[1:].split("\n") for p in lined if p[0] == "\n"]
        of_lines = [p.split("\n") for p in lined if p[0] != "\n"]
        self._learn(0, {w for x in first_of_text for w in x}.union(*(x[1:] for x in of_lines)))
        self._learn(1, {x[0] for x in of_lines}.union(p for p in new if "\n" not in p))
        join = self.line_end.join
        held = {"\n" + "\n".join(x): join([bare[w] for w in x]) for x in first_of_text}
        held.update(("\n".join(x), join([after_blank[x[0]], *[bare[w] for w in x[1:]]])) for x in of_lines)
        return [held[p] if p in held else after_blank[p] for p in pieces] if held else [after_blank[p] for p in pieces]

    def _learn(self, blanks: int, words: set[str]) -> None:
        known = self.known[blanks]
        words = [w for w in words if w not in known]
        stems = [_stem(w) for w in words]
        new = list({s for s in stems if s not in known})
        known.update(zip(new, self._ask([" " * blanks + w for w in new]), strict=True))
        longer = [(w, s, w[len(s) :]) for w, s in zip(words, stems, strict=True) if len(s) < len(w)]
        tails = list({tail for _, _, tail in longer})
        endings = dict(zip(tails, self._ask(tails), strict=True))
        known.update((w, known[stem] + endings[tail]) for w, stem, tail in longer)

    def _ask(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without line ends, in one call; line ends part them again."""
        if not texts:
            return []
        raw = self._encode("\n".join(texts))
        ends = (np.flatnonzero(np.frombuffer(raw, "<u4") == np.frombuffer(self.line_end, "<u4")) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True)]


def _stem(word: str) -> str:
    """A word without the signs at its end, if those are tokens of their own after a letter or digit."""
    stem = word.rstrip(_ENDINGS)
    return stem if stem and stem[-1].isalnum() else word


class Piece(NamedTuple):
    doc: object
    start: int
    ids: bytes
    doc_tokens: int

    @property
    def size(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[: 4 * n]), self._replace(start=self.start + n, ids=self.ids[4 * n :])


def best_fill(counts: dict[int, int], lengths: list[int], capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``capacity`` of a multiset of ``lengths``, and its count by length.

    Bit s of ``reach`` says that s can be filled. A length with many copies comes in groups of 1,
    2, 4, ... copies. The states before each group are kept, and going back through them tells
    which groups the best sum has.
    """
    reach, full, groups = 1, 1 << capacity, (1 << (capacity + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for place in range(bisect_left(lengths, capacity + 1) - 1, -1, -1):
        length = lengths[place]
        left, copies = min(counts[length], capacity // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & groups
            left -= copies
            copies *= 2
        if reach & full:
            break
    fill = reach.bit_length() - 1
    left, used = fill, {}
    for length, copies, before in reversed(steps):
        if not (before >> left) & 1:
            used[length] = used.get(length, 0) + copies
            left -= length * copies
    return fill, used


class Packer:
    """Packs pieces of documents into sequences; ``rows`` gets a tuple for each placed piece."""

    def __init__(self, capacity: int = CAPACITY, first_sequence: int = 0) -> None:
        self.capacity, self.sequence = capacity, first_sequence
        self.waiting: dict[int, list[Piece]] = {}
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []
        self.total = self.pieces = 0
        self.rows: list[tuple] = []

    def add(self, doc: object, ids: bytes) -> None:
        """Place the whole windows of a document; its remainder waits."""
        n = len(ids) // 4
        rest = Piece(doc, 0, ids, n)
        while rest.size >= self.capacity:
            window, rest = rest.cut(self.capacity)
            self._close([window])
        if rest.size:
            self._wait(rest)
        while self.pieces >= POOL:
            self._fill_window(self.capacity)

    def finish(self) -> None:
        while self.total >= self.capacity:
            self._fill_window(self.capacity)
        while self.total:
            self._fill_window(1 << (self.total.bit_length() - 1))

    def _wait(self, piece: Piece) -> None:
        n = piece.size
        if n not in self.counts:
            insort(self.lengths, n)
            self.counts[n], self.waiting[n] = 0, []
        self.counts[n] += 1
        self.waiting[n].append(piece)
        self.total += n
        self.pieces += 1

    def _take(self, n: int) -> Piece:
        piece = self.waiting[n].pop()
        self.counts[n] -= 1
        self.total -= n
        self.pieces -= 1
        if not self.counts[n]:
            del self.counts[n], self.waiting[n]
            self.lengths.pop(bisect_left(self.lengths, n))
        return piece

    def _fill_window(self, size: int) -> None:
        """A sequence of exactly ``size`` ids, of which at least as many wait."""
        longest = self._take(self.lengths[-1])
        if longest.size > size:
            longest, rest = longest.cut(size)
            self._wait(rest)
        fill, used = best_fill(self.counts, self.lengths, size - longest.size) if longest.size < size else (0, {})
        chosen = [longest, *(self._take(n) for n, copies in used.items() for _ in range(copies))]
        slack = size - longest.size - fill
        if slack:  # every piece left is longer than the slack
            part, rest = self._take(self.lengths[0]).cut(slack)
            self._wait(rest)
            chosen.append(part)
        self._close(chosen)

    def _close(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((p.doc, p.start, p.size, zlib.crc32(p.ids), p.doc_tokens, self.sequence, offset))
            offset += p.size
        self.sequence += 1


def _blocks(batch: pa.RecordBatch, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about ``most`` bytes of text at a time."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    block = (np.cumsum(size) - size) // most
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(batch) else []
    for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
        yield batch.slice(a, b - a)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, remembered: int = REMEMBERED, block: int = BLOCK) -> DataFrame:
    """One row per placed piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text (null: empty) and then id 0, so an empty text is one
    id. Sequences hold ``capacity`` ids; the last ids of each task make sequences of a power of
    two. Repeated rows and rows without doc_id are documents of their own. Sequence ids are unique
    over tasks and agree when a task runs again; an empty table gives no rows. ``remembered`` and ``block``
    (bytes tokenised together) bound a worker's memory and change no row.
    """
    narrow = docs.select("doc_id", "text")
    kind = pa.string() if narrow.schema["doc_id"].dataType.simpleString() == "string" else pa.int64()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        tokens = TokenBytes.of(tokenizer_path, remembered)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)

        def placed() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * len(names)
            packer.rows = []
            arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for part in _blocks(batch, block):
                texts = [t or "" for t in part.column(1).to_numpy(zero_copy_only=False)]
                for doc, ids in zip(part.column(0).to_pylist(), tokens.block(texts), strict=True):
                    packer.add(doc, ids + END)
                if len(packer.rows) >= 50_000:
                    yield placed()
        packer.finish()
        yield placed()

    id_type = "string" if kind == pa.string() else "long"
    return narrow.mapInArrow(pack, f"doc_id {id_type}, " + ", ".join(f"{n} long" for n in names[1:]))
