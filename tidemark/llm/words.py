"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r (these are single bytes in UTF-8, so
bytes and code points split alike). A word's hash is a polynomial over its bytes modulo 2**64, finished with a
mixing step; equal words always have equal hashes and unequal ones differ but for a chance near 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes of text handled in one numpy step; arrays of eight times that size are alive meanwhile.
SLICE_BYTES = 1 << 20
_MUL = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = SLICE_BYTES
    while size < n:
        size *= 2
    if size not in _powers:
        inverse = pow(_MUL, -1, 1 << 64)
        out = []
        for m in (_MUL, inverse):
            p = np.full(size + 1, m, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > SLICE_BYTES:
            return out[0], out[1]
        _powers[size] = (out[0], out[1])
    return _powers[size]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end, and the n + 1 offsets. A null text has no bytes."""
    column = column.cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return raw[lo:hi], offsets - lo


def slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about SLICE_BYTES each; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; words never cross a document's end."""
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = word[:-1]
    start = word & (~before | first[:-1])
    after = np.zeros(len(data), bool)
    if len(data):
        after[:-1] = word[1:]
    end = word & (~after | first[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first word of each document and the total) for a slice of documents.

    A document longer than a slice is cut at white space, so its hashes need no larger tables.
    """
    starts, ends = _bounds(data, offsets)
    firsts = np.searchsorted(starts, offsets).astype(np.int64)
    if lower:
        data = _LOWER[data]
    return span_hashes(data, starts, ends), starts, ends, firsts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans whose starts and ends both rise."""
    hashes = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")), i + 1)
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, inverse = _tables(hi - lo)
        sums = np.zeros(hi - lo + 1, _U)
        np.cumsum((data[lo:hi].astype(_U) + _U(1)) * power[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        hashes[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(hashes)


_COMBINE = [0xD6E8FEB86659FD93, 0xA5A3564E27F8862B, 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingles of one document's word hashes, sorted; with fewer words, the whole sequence as one."""
    n = len(words)
    if n == 0:
        return words
    w = min(k, n)
    total = np.full(n - w + 1, (w * 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF, _U)
    for j in range(w):
        total += words[j : n - w + 1 + j] * _U(_COMBINE[j % 8] + 2 * (j // 8))
    return np.unique(mix(total))
