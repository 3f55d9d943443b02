"""Word and window hashes of whole texts, vectorised over the bytes of an Arrow column.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.  All separators are ASCII, so
splitting UTF-8 bytes and splitting code points give the same words.  Texts are handled in slices
of about ``SLICE_BYTES`` (one longer text is one slice, hashed block by block), which bounds memory
whatever the Arrow batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (splitmix64): a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = np.uint64(base)
        self.values = np.ones(1, np.uint64)

    def first(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            steps = np.full(max(n, 2 * len(self.values)), self.base, np.uint64)
            steps[0] = 1
            self.values = np.cumprod(steps)
        return self.values[:n]


_POW, _INV = _Powers(_BASE), _Powers(_INVERSE)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_BYTE_CODE_LOWER = _BYTE_CODE.copy()
_BYTE_CODE_LOWER[0x41:0x5B] = _BYTE_CODE[0x61:0x7B]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null entries become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def _blocks(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most about SLICE_BYTES, cut after a separator."""
    while hi - lo > SLICE_BYTES:
        cut = lo + SLICE_BYTES
        found = np.flatnonzero(_SEPARATOR[data[lo:cut]])
        if len(found):
            cut = lo + int(found[-1]) + 1
        else:
            while cut < hi and not _SEPARATOR[data[cut]]:
                cut += 1
        yield lo, cut
        lo = cut
    if hi > lo:
        yield lo, hi


def _hash_block(data: np.ndarray, lo: int, hi: int, edges: np.ndarray, codes: np.ndarray):
    """Hashes and start offsets of the words in data[lo:hi]; edges: text starts inside the block."""
    part = data[lo:hi]
    inside = ~_SEPARATOR[part]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = edges[(edges > lo) & (edges < hi)] - lo
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    n = len(part)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[part] * _POW.first(n), out=sums[1:])
    return mix((sums[last] - sums[first]) * _INV.first(n)[first]), first + lo


def word_slices(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, word hashes, word offsets by row) for slices of the column.

    ``offsets[i]:offsets[i + 1]`` are the words of row ``first + i``.  ``lower`` folds A-Z.
    """
    data, at = text_buffers(column)
    codes = _BYTE_CODE_LOWER if lower else _BYTE_CODE
    row, rows = 0, len(at) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1)
        edges = at[row:stop + 1]
        hashes, starts = [], []
        for lo, hi in _blocks(data, int(at[row]), int(at[stop])):
            h, s = _hash_block(data, lo, hi, edges, codes)
            hashes.append(h)
            starts.append(s)
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        begins = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        yield row, stop, words, np.searchsorted(begins, edges)
        row = stop


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` consecutive words (modulo 2**64, then mixed)."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _POW.first(n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * _INV.first(n)[:n - width + 1] + np.uint64(salt))


def whole_hash(words: np.ndarray, salt: int = 0) -> np.uint64:
    """Hash of a whole word sequence together with its length."""
    tail = np.uint64((salt + len(words) * _M1.item()) % (1 << 64))
    return mix(np.array([(words * _POW.first(len(words))).sum(dtype=np.uint64)]) + tail)[0]
