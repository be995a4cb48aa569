"""Elias-Fano sequences and an n-gram trie of them in one block of memory, searched for many values at once.

A monotone sequence keeps the low bits of its values packed and the high bits in unary; a directory of the ones before each 64-bit
word makes both kinds of select a search.  A trie level holds contexts, pointers to where each context's successors start, and
the successors.  These begin anew in each context; they are kept as offsets from the end of the context before, so the whole level
is one monotone sequence, and a word is found by successor search relative to its context.
"""

from __future__ import annotations

import tempfile

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SELECT = np.zeros((256, 8), np.uint8)  # the place of the k-th one of a byte
for _i in range(256):
    for _k, _p in enumerate(p for p in range(8) if _i >> p & 1):
        _SELECT[_i, _k] = _p


def _padded(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(-(-len(raw) // 8) * 8 + 8, np.uint8)
    out[: len(raw)] = raw
    return out


class EliasFano:
    """A non-decreasing sequence of numbers below 2^57."""

    def __init__(self, n: int, shift: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, last: int):
        self.n, self.shift, self.low, self.high, self.ones, self.last = n, shift, low, high, ones, last
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        self.windows = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))  # eight bytes from each byte on

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.int64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        shift = max(0, ((last + 1) // max(n, 1)).bit_length() - 1)
        bits = ((values[:, None] >> np.arange(shift)) & 1).astype(np.uint8) if shift else np.zeros((n, 0), np.uint8)
        high = np.zeros((last >> shift) + n + 2, np.uint8)
        high[(values >> shift) + np.arange(n)] = 1
        high = _padded(np.packbits(high, bitorder="little"))
        per_word = _ONES[high].reshape(-1, 8).sum(1, dtype=np.int64)
        return cls(n, shift, _padded(np.packbits(bits.ravel(), bitorder="little")), high, np.cumsum(per_word) - per_word, last)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.shift, self.last], np.int64).view(np.uint8), self.low, self.high, self.ones.astype(np.int64).view(np.uint8)]

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th one (or zero) of the high bits, from 0."""
        before = self.ones if one else self.zeros
        word = np.searchsorted(before, k, "right") - 1
        left = k - before[word]
        place, open_ = word * 64, np.ones(len(k), bool)
        out = np.zeros(len(k), np.int64)
        for b in range(8):
            byte = self.high[word * 8 + b]
            byte = byte if one else ~byte
            n = _ONES[byte]
            here = open_ & (left < n)
            out[here] = place[here] + b * 8 + _SELECT[byte[here], left[here]]
            open_ &= ~here
            left = left - n
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.shift
        return ((self.windows[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.shift) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i) << self.shift) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the place of the first value that is x or more; n where there is none."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        top = np.minimum(x, self.last)
        h = top >> self.shift
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - np.maximum(h - 1, 0), 0)
        hi = self._select(h, False) - h
        low = top & ((1 << self.shift) - 1)
        while (open_ := lo < hi).any():  # by halves among the values with these high bits
            i = np.flatnonzero(open_)
            mid = (lo[i] + hi[i]) >> 1
            less = self._low(mid) < low[i]
            lo[i] = np.where(less, mid + 1, lo[i])
            hi[i] = np.where(less, hi[i], mid)
        return np.where(x > self.last, self.n, lo)


class Trie:
    """Contexts with their successors and a code of one byte for each, in a memory-mapped file."""

    def __init__(self, raw: np.ndarray):
        sizes = raw[:104].view(np.int64)
        ends = np.cumsum(np.append(104, sizes))
        piece = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        level = lambda p: EliasFano(*(int(x) for x in p[0].view(np.int64)[:2]), p[1], p[2], p[3].view(np.int64), int(p[0].view(np.int64)[2]))
        self.contexts, self.pointers, self.successors = level(piece[0:4]), level(piece[4:8]), level(piece[8:12])
        self.codes = piece[12]

    @staticmethod
    def layout(context: np.ndarray, word: np.ndarray, code: np.ndarray) -> bytes:
        """The levels of n-grams sorted by context and word; all arrays of one length."""
        heads = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
        ends = np.append(heads[1:], len(context))
        base = np.append(0, np.cumsum(word[ends - 1] + 1)[:-1]) if len(heads) else np.zeros(0, np.int64)
        levels = (EliasFano.of(context[heads]), EliasFano.of(np.append(heads, len(context))), EliasFano.of(word + np.repeat(base, ends - heads)))
        parts = [p for level in levels for p in level.parts()] + [code.astype(np.uint8)]
        return np.concatenate([np.array([len(p) for p in parts], np.int64).view(np.uint8), *parts]).tobytes()

    @classmethod
    def mapped(cls, raw: bytes) -> Trie:
        """The trie in a temporary file that is mapped into memory and has no name, so nothing of it stays."""
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            return cls(np.memmap(f, np.uint8, "r"))

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each n-gram, -1 where it is none; queries sorted by context are quickest."""
        out = np.full(len(context), -1, np.int64)
        if not self.contexts.n or not len(context):
            return out
        heads = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(context))))
        wanted = context[heads]
        place = np.minimum(self.contexts.successor(wanted), self.contexts.n - 1)
        known = self.contexts.access(place) == wanted
        start, end = self.pointers.access(place), self.pointers.access(place + 1)
        base = np.where(start > 0, self.successors.access(np.maximum(start - 1, 0)) + 1, 0)
        rows = np.flatnonzero(known[group])
        g = group[rows]
        x = base[g] + word[rows]
        at = self.successors.successor(x)
        inside = np.flatnonzero(at < end[g])
        inside = inside[self.successors.access(at[inside]) == x[inside]]
        out[rows[inside]] = self.codes[at[inside]]
        return out
