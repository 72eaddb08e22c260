"""Vectorised words of Arrow text columns.

A word is a maximal run of bytes other than space and \\t..\\r, which for
UTF-8 text equals the regex ``[^\\x20\\x09-\\x0D]+`` over code points.  The
functions work on whole Arrow chunks with numpy: one prefix sum gives every
word's 64-bit polynomial hash, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_POW: list[np.ndarray] = []
_U = np.uint64


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
           max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice batches so the text of a slice stays near ``max_bytes`` (a
    single longer text is a slice of its own); rows keep their order."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        offsets, _ = text_buffers(batch.column(column))
        start = 0
        while start < n:
            stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
            stop = min(n, max(start + 1, stop))
            yield batch.slice(start, stop - start)
            start = stop


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = col.buffers()
    o = np.frombuffer(offsets, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o - o[0], d[o[0]:o[-1]]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        both = []
        for base in (_P, _PINV):
            a = np.full(size, base, _U)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        if n > 8 * CHUNK_BYTES:  # one very long text: don't keep its tables
            return both[0], both[1]
        _POW[:] = both
    return _POW[0], _POW[1]


class Words:
    """The words of a chunk: ``doc`` (row of the chunk), ``start``/``end``
    (bytes in ``data``), ``first`` (index of each row's first word, plus the
    total) and ``hash``."""

    def __init__(self, col: pa.Array, lower: bool = False, space: np.ndarray = _SPACE):
        self.offsets, data = text_buffers(col)
        self.data = _LOWER[data] if lower else data
        n = len(data)
        inside = ~space[data]
        edge = np.zeros(n + 1, bool)  # a new text ends the word before it
        edge[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        n = len(self.data)
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * up[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(_U) * _U(0xD6E8FEB86659FD93))


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a word-hash sequence (by start index); the
    caller masks grams that cross a text boundary."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for j in range(k):
        out = (out ^ h[j:j + n]) * _U(0xFF51AFD7ED558CCD)
        out ^= out >> _U(32)
    return mix(out + _U(k))


def string_hash(col: pa.Array) -> np.ndarray:
    """64-bit hash of each string's bytes (same function as ``Words.hash``)."""
    offsets, data = text_buffers(col)
    n = len(data)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=total[1:])
    h = (total[offsets[1:]] - total[offsets[:-1]]) * down[offsets[:-1]]
    return mix(h + np.diff(offsets).astype(_U) * _U(0xD6E8FEB86659FD93))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i]..starts[i]+lengths[i]-1, concatenated."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
