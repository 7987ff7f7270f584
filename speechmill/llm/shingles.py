"""Words and word shingles of Arrow string columns, hashed with numpy over whole batches.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D`` with A-Z lower-cased, so all work is done on
the UTF-8 bytes of the Arrow buffer: a polynomial prefix hash modulo 2**64 gives the hash of
every word in one pass (the base is odd, hence invertible), shingles combine word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes handled at once: the working arrays then stay in the processor's cache.
CHUNK_BYTES = 1 << 18
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes; a longer row is a range of its own."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the rows, and for each row where its words begin (and the end).
    space: which of the 256 bytes separate words."""
    n = len(data)
    rows = len(off) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    low = _LOWER[data]
    solid = ~space[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:n]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    words = mix((total[end] - total[start]) * down[start])
    return words, np.searchsorted(start, off)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the ``k``-word shingles of every row in text order, with the offsets of the
    rows. A row of 1 to k-1 words has its whole sequence as its one shingle; no words, none."""
    rows = len(first) - 1
    count = np.diff(first)
    per = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_off = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(per, out=out_off[1:])
    out = np.zeros(out_off[-1], dtype=np.uint64)
    if not len(out):
        return out, out_off
    weight = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    full = count >= k
    if full.any():
        m = len(words) - k + 1
        acc = words[:m] * weight[0]
        for t in range(1, k):
            acc += words[t : t + m] * weight[t]
        take = np.repeat(full, per)
        index = np.arange(out_off[-1]) - np.repeat(out_off[:-1], per) + np.repeat(first[:-1], per)
        out[take] = acc[index[take]]
    for row in np.flatnonzero((count > 0) & ~full):
        w = words[first[row] : first[row + 1]]
        out[out_off[row]] = (w * weight[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
    return mix(out), out_off


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a string column."""
    data, off = string_buffer(column)
    for i, j in slices(off):
        words, first = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        h, at = shingle_hashes(words, first, k)
        for r in range(j - i):
            yield i + r, np.unique(h[at[r] : at[r + 1]])
