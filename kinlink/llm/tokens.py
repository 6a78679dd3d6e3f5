"""Vectorised word splitting and hashing over Arrow string batches.

A word is a maximal run of bytes outside a separator class; classes are byte tables, so UTF-8 letters never split.
Words are hashed with a polynomial over the odd multiplier `BASE` modulo 2^64, read off one running sum per piece of
text, then finalised. The hash depends on the bytes of the word only. All functions take any size of text: long texts
are hashed in pieces cut between words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 20

_space = np.zeros(256, dtype=bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Words `[^\x20\x09-\x0D]+`.
SPACE_SEPARATED = _space
_alnum = np.ones(256, dtype=bool)
_alnum[0x80:] = False
_alnum[0x30:0x3A] = False
_alnum[0x61:0x7B] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (apply to lower-cased text).
ALNUM = _alnum

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, PIECE + 1)
        ones = np.full(size, BASE, dtype=np.uint64)
        ones[0] = 1
        inverse = np.full(size, np.uint64(pow(int(BASE), -1, 1 << 64)), dtype=np.uint64)
        inverse[0] = 1
        _powers["p"], _powers["i"] = np.cumprod(ones, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, one after another, and the n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        wide = np.int64
    else:
        wide = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if lengths.sum() != offsets[-1] - offsets[0]:
            parts = [data[a : a + k] for a, k in zip(offsets[:-1], lengths)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else unchanged."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word crosses a text's edge."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans are in order and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        piece = data[base : ends[to - 1]]
        power, inverse = _tables(len(piece) + 1)
        running = np.empty(len(piece) + 1, dtype=np.uint64)
        running[0] = 0
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)], out=running[1:])
        a, b = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((running[b] - running[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, hashes, and the n+1 bounds of each text's words in them."""
    starts, ends = spans(data, offsets, separators)
    return starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words (len - k + 1 of them, texts' edges not minded)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0xA0761D6478BD642F)
        out ^= out >> np.uint64(32)
        out += hashes[i : i + n]
    return mix(out)


def slices(offsets: np.ndarray, most: int):
    """Row ranges (a, b) of at most `most` bytes each, or of one text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b
