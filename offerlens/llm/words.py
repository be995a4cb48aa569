"""Words of whole Arrow text columns as NumPy arrays.

Tasks see texts as one byte buffer with the place of each document in it.  Words are runs of bytes outside white space
(0x20, 0x09 to 0x0D); letters A to Z are lower-cased, other bytes stay as they are.  A word is identified by a 64-bit
hash of its bytes: two of a billion different words meet with a chance of a few hundredths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finishing steps of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_BYTE[_SPACE] = 0


def _power(n: int) -> np.ndarray:
    """Powers of the base modulo 2^64 for n places in a word."""
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 256), _BASE, np.uint64)
        full[0] = 1
        _powers = np.cumprod(full, dtype=np.uint64)
    return _powers


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text starts (one more place than texts); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows whose texts have about `limit` bytes (one row at least), each with its byte buffer and offsets.

    It bounds the memory of what follows by the limit and the longest text, whatever the size of an Arrow batch.
    """
    buf, offs = buffer_of(batch.column(column))
    at = 0
    while at < len(offs) - 1:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), buf[offs[at]: offs[to]], offs[at: to + 1] - offs[at]
        at = to


def lowered(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def starts_of(inside: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where runs of `inside` bytes start; a run ends with its document."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    first[heads] |= inside[heads]
    return np.flatnonzero(first)


def hashes(buf: np.ndarray, starts: np.ndarray, silent: np.ndarray = _SPACE) -> np.ndarray:
    """A hash of each run that begins at `starts`; bytes marked `silent` stand between runs and count for nothing."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    buf = buf[starts[0]:]
    at = starts - starts[0]
    lengths = np.diff(np.append(at, len(buf)))
    place = np.arange(len(buf), dtype=np.int64) - np.repeat(at, lengths)
    weights = _BYTE if silent is _SPACE else np.where(silent, np.uint64(0), _BYTE)
    return mix(np.add.reduceat(weights[buf] * _power(int(lengths.max()))[place], at))


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in reading order, and at which word each document starts (one more place than documents)."""
    low = _LOWER[buf]
    starts = starts_of(~_SPACE[low], offs) if len(low) else np.zeros(0, np.int64)
    return hashes(low, starts), np.searchsorted(starts, offs)


_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 letters and bytes above ASCII, 2 digits, 3 other signs
_KIND[_SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def kind_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like word_hashes for runs of one kind (letters, digits, other signs), with capital letters as they are."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    kind = _KIND[buf]
    first = np.ones(len(buf), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[offs[:-1][offs[:-1] < len(buf)]] = True
    starts = np.flatnonzero(first & (kind > 0))
    return hashes(buf, starts), np.searchsorted(starts, offs)


def chain(*parts: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hashes of its parts; order counts."""
    out = parts[0]
    for p in parts[1:]:
        out = mix(out * _BASE + p)
    return out
