"""Threshold-bounded interval expansion on a Burrows-Wheeler transform of a few megabytes.

The suffixes of some byte strings are sorted, and the symbols before them, in that order, are the
transform. Intervals of suffixes that begin alike are extended backwards, breadth first, by every
symbol that stands before one of them: an interval of prefixes of n symbols gives intervals of
n + 1. Where an interval ends that has not ended before, the common prefix of the two suffixes
that meet there has just n symbols, so common prefixes come out by increasing value and each place
costs one interval. At ``least`` the expansion stops: suffixes that no interval has parted by then
share ``least`` symbols or more. No hash is involved.
"""

from __future__ import annotations

import numpy as np

#: Symbols that the first sort compares; a string's end is a symbol of its own, before all bytes.
FIRST = 6
#: Strings, at most, that one transform holds: ends and FIRST symbols fit in one number.
MOST_STRINGS = 16_000


def joined(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all strings, bytes from 1 on and 0 for an end, and the places of the ends."""
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    symbols = np.zeros(int(ends[-1]) + 1, np.int16)
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.concatenate(strings)
    symbols[inside] += 1
    return symbols, ends


def suffix_order(symbols: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Suffixes in order by their first ``least`` symbols at least; ends differ from each other.

    Prefixes are doubled, and only suffixes that are not yet alone in their rank are sorted again.
    """
    n = len(symbols)
    own_end = np.searchsorted(ends, np.arange(n))
    left = ends[own_end] - np.arange(n)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([symbols, np.zeros(FIRST, symbols.dtype)])
    for j in range(FIRST):
        key = key * 257 + np.where(left >= j, padded[j : j + n], 0)
    key = key * (len(ends) + 2) + np.where(left < FIRST, own_end + 1, 0)
    order = np.argsort(key)
    slots, items, keys, known = np.arange(n), order, key[order], FIRST
    rank = np.empty(n, np.int64)
    while True:
        new = np.r_[True, keys[1:] != keys[:-1]]
        rank[items] = slots[np.maximum.accumulate(np.where(new, np.arange(len(items)), 0))]
        tied = ~(new & np.r_[new[1:], True])
        if known >= least or not tied.any():
            return order
        slots, items = slots[tied], items[tied]
        keys = rank[items] * n + rank[items + known]
        sorting = np.argsort(keys)
        items, keys = items[sorting], keys[sorting]
        order[slots] = items
        known *= 2


class Transform:
    """The Burrows-Wheeler transform of sorted suffixes, with backward extension of intervals."""

    def __init__(self, symbols: np.ndarray, order: np.ndarray) -> None:
        used, coded = np.unique(symbols, return_inverse=True)
        self.last = coded.astype(np.uint8 if len(used) <= 256 else np.uint16)[order - 1]
        self.begin = np.cumsum(np.r_[0, np.bincount(coded, minlength=len(used))])
        self.before = np.empty(len(order), np.int64)  # the place of a suffix with one symbol more
        self.before[np.argsort(self.last, kind="stable")] = np.arange(len(order))
        self.bits = range(int(len(used) - 1).bit_length() - 1, -1, -1)
        self.zeros, row = [], self.last
        for bit in self.bits:
            one = (row >> bit) & 1 == 1
            self.zeros.append(np.r_[0, np.cumsum(~one)].astype(np.int32))
            row = np.concatenate([row[~one], row[one]])
        self.row_start = np.zeros(len(used), np.int64)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        self.row_start[row[first]] = first

    def extended(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals [low, high) with each symbol but an end put before them, where any has it."""
        alone = high - low == 1
        place = low[alone]
        single = self.before[place[self.last[place] != 0]]
        a, b = low[~alone], high[~alone]
        symbol = np.zeros(len(a), np.int64)
        for zeros in self.zeros:
            za, zb = zeros[a], zeros[b]
            oa, ob = a - za + zeros[-1], b - zb + zeros[-1]
            zero, one = zb > za, ob > oa
            a, b = np.concatenate([za[zero], oa[one]]), np.concatenate([zb[zero], ob[one]])
            symbol = np.concatenate([symbol[zero] * 2, symbol[one] * 2 + 1])
        real = symbol > 0
        shift = (self.begin[:-1] - self.row_start)[symbol[real]]
        return np.concatenate([single, a[real] + shift]), np.concatenate([single + 1, b[real] + shift])


def repeated_windows(strings: list[np.ndarray], least: int) -> list[np.ndarray]:
    """For each string, which of its windows of ``least`` bytes also start anywhere else."""
    symbols, ends = joined(strings)
    order = suffix_order(symbols, ends, least)
    transform, n = Transform(symbols, order), len(order)
    together = np.ones(n + 1, bool)
    together[[0, n]] = False
    low = np.r_[np.arange(len(ends)), transform.begin[1:-1]]
    high = np.r_[np.arange(len(ends)) + 1, transform.begin[2:]]
    for _ in range(least):
        fresh = together[high]
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        together[high] = False
        low, high = transform.extended(low, high)
    found = np.zeros(n, bool)
    found[order[together[:-1] | together[1:]]] = True
    return [found[e - len(s) : e - len(s) + max(0, len(s) - least + 1)] for s, e in zip(strings, ends, strict=True)]
