"""Levels of an n-gram trie in Elias-Fano form, mapped from bytes, with vectorised queries.

A key is a context (HALF bits) and a successor (HALF bits). Contexts ascend; each
has a run of ascending successors. Three monotone sequences hold them: contexts,
pointers to where runs begin, and successors relative to their context (run number
* 2 ** HALF + successor). Values are quantised log10 numbers, one 16-bit code a
successor. A query finds its context by successor search, takes the two pointers
around its run, and searches for the successor in that run only.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np

U = np.uint64
#: Bits of a context, and of a successor.
HALF = 20
#: Code of a key that is not there.
NONE = -32768
#: Codes are value * STEPS, rounded.
STEPS = 2048


def quantise(value: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(value * STEPS), -32768, 32767).astype(np.int16)


#: Set bits of a byte, and the place of the first, second ... of them.
_COUNT = np.bitwise_count(np.arange(256, dtype=np.uint8))
_PLACE = np.argsort(~np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool), axis=1, kind="stable").astype(np.uint8)


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    parts = np.ascontiguousarray(word).view(np.uint8).reshape(-1, 8)
    until = np.cumsum(_COUNT[parts], axis=1, dtype=np.uint8)
    rank = rank.astype(np.uint8)
    at = (until <= rank[:, None]).sum(axis=1)
    row = np.arange(len(parts))
    rank = rank - np.where(at > 0, until[row, at - 1], 0).astype(np.uint8)
    return at * 8 + _PLACE[parts[row, at], rank]


class EliasFano:
    """Ascending whole numbers below 2 ** 63: low bits packed, high parts as unary gaps."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._places: dict[bool, np.ndarray] = {}
        self._selected = {True: 0, False: 0}

    @cached_property
    def ones(self) -> np.ndarray:
        """Ones before each word of the high parts."""
        return np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)])

    @cached_property
    def zeros(self) -> np.ndarray:
        return np.arange(len(self.high) + 1, dtype=np.int64) * 64 - self.ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(U)
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(-(-n * bits // 64) + 2, U)
        if bits:
            for i in range(0, n, 1 << 16):
                # whole words: 2 ** 16 values of any number of bits fill them
                part = values[i : i + (1 << 16)] & U((1 << bits) - 1)
                at = np.arange(i, i + len(part), dtype=np.int64) * bits
                word, shift = at >> 6, (at & 63).astype(U)
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
                # only the last number that begins in a word can go on in the next
                over = np.flatnonzero(shift > U(64 - bits))
                low[word[over] + 1] |= part[over] >> (U(64) - shift[over])
        place = (values >> U(bits)).astype(np.int64) + np.arange(n)
        size = (universe >> bits) + n + 64
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[place] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little").view(U))

    def _directory(self, one: bool) -> np.ndarray:
        """Places of all ones or zeros of the high parts."""
        if one not in self._places:
            bits = np.unpackbits(np.asarray(self.high).view(np.uint8), bitorder="little")
            self._places[one] = np.flatnonzero(bits if one else bits == 0)
        return self._places[one]

    def select(self, i: np.ndarray, one: bool) -> np.ndarray:
        """Where the i-th one or zero of the high parts is; many, at once or one after another, pay for a directory."""
        self._selected[one] += len(i)
        if self._selected[one] * 16 > len(self.high) * 64 or one in self._places:
            return self._directory(one)[i]
        total = self.ones if one else self.zeros
        word = np.searchsorted(total, i, side="right") - 1
        bits = np.asarray(self.high[word])
        return word * 64 + _select_in_word(bits if one else ~bits, i - total[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.select(i, True) - i).astype(U) << U(self.low_bits)) | self._low(i)

    @cached_property
    def _lanes(self) -> np.ndarray:
        """A view of the low bits that reads eight bytes from any place."""
        return np.ndarray(max(0, 8 * len(self.low) - 7), "<u8", self.low, strides=(1,))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i * self.low_bits
        if self.low_bits <= 57:
            # eight bytes from the byte where a number begins hold it
            return (self._lanes[at >> 3] >> (at & 7).astype(U)) & U((1 << self.low_bits) - 1)
        word, shift = at >> 6, (at & 63).astype(U)
        over = np.where(shift > 0, np.asarray(self.low[word + 1]) << ((U(64) - shift) & U(63)), U(0))
        return ((np.asarray(self.low[word]) >> shift) | over) & U((1 << self.low_bits) - 1)

    def find(self, x: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each x among the numbers start .. end - 1, or -1: successor search in the numbers of equal high part."""
        high = (x >> U(self.low_bits)).astype(np.int64)
        lo = np.where(high > 0, self.select(np.maximum(high - 1, 0), False) - high + 1, 0)
        hi = self.select(high, False) - high
        if start is not None:
            lo, hi = np.maximum(lo, start), np.minimum(hi, end)
        # between them high parts are equal, so that low bits decide
        low, some = x & U((1 << self.low_bits) - 1), np.flatnonzero(lo < hi)
        live = some[hi[some] - lo[some] > 1]
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            more = self._low(mid) > low[live]
            hi[live[more]], lo[live[~more]] = mid[more], mid[~more]
            live = live[hi[live] - lo[live] > 1]
        out = np.full(len(x), -1, np.int64)
        hit = some[self._low(lo[some]) == low[some]]
        out[hit] = lo[hit]
        return out

    def all(self) -> np.ndarray:
        """All numbers, ascending."""
        places = self._directory(True)[: self.n]
        i = np.arange(self.n, dtype=np.int64)
        return ((places - i).astype(U) << U(self.low_bits)) | self._low(i)

    def to_bytes(self) -> bytes:
        return struct.pack("<4q", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def view(cls, data: np.ndarray, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that begins at a byte, without a copy, and where it ends."""
        n, bits, low, high = struct.unpack("<4q", data[at : at + 32].tobytes())
        at += 32
        end = at + 8 * (low + high)
        return cls(n, bits, data[at : at + 8 * low].view(U), data[at + 8 * low : end].view(U)), end


class NgramTrie:
    """Codes of (context, successor) keys."""

    MAGIC = b"EFT2\0\0\0\0"

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @classmethod
    def build(cls, keys: np.ndarray, codes: np.ndarray) -> NgramTrie:
        """keys: ascending and distinct."""
        context = keys >> U(HALF)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.empty(0, np.int64)
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys)))).astype(U)
        return cls(
            EliasFano.build(context[first], 1 << HALF),
            EliasFano.build(np.append(first, len(keys)), len(keys) + 1),
            EliasFano.build((run << U(HALF)) | (keys & U((1 << HALF) - 1)), max(1, len(first)) << HALF),
            codes,
        )

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among all, or -1. Neighbours of one context share its search."""
        out = np.full(len(keys), -1, np.int64)
        if not len(keys) or not self.contexts.n:
            return out
        context = keys >> U(HALF)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        run = self.contexts.find(context[first])
        start, end = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        known = np.flatnonzero(run >= 0)
        start[known], end[known] = self.pointers.get(run[known]), self.pointers.get(run[known] + 1)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        ask = np.flatnonzero(run[of] >= 0)
        o = of[ask]
        out[ask] = self.successors.find((run[o].astype(U) << U(HALF)) | (keys[ask] & U((1 << HALF) - 1)), start[o], end[o])
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Code of each key; NONE if it isn't there."""
        at = self.find(keys)
        return np.where(at >= 0, self.codes[at] if len(self.codes) else NONE, NONE).astype(np.int16)

    def to_bytes(self) -> bytes:
        return self.MAGIC + b"".join(x.to_bytes() for x in (self.contexts, self.pointers, self.successors)) + self.codes.astype("<i2").tobytes()

    @classmethod
    def view(cls, data: np.ndarray) -> NgramTrie:
        """Maps the levels onto bytes; nothing is copied or computed beforehand."""
        if data[:8].tobytes() != cls.MAGIC:
            raise ValueError("not a trie")
        at, levels = 8, []
        for _ in range(3):
            level, at = EliasFano.view(data, at)
            levels.append(level)
        return cls(*levels, data[at:].view("<i2"))

    @classmethod
    def open(cls, path: str) -> NgramTrie:
        """A trie in a file, memory-mapped."""
        return cls.view(np.memmap(path, np.uint8, "r"))
