"""Word and shingle hashes of whole Arrow batches with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words longer than this are hashed one by one.
_LONG = 48
#: Bytes of text hashed at once.
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, first byte, byte after the last) of each word of the texts, in order."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = ~space & np.concatenate(([True], space[:-1])) | ~space & edge[:-1] if len(data) else space
    starts = np.flatnonzero(begin)
    stop = ~space & (np.concatenate((space[1:], [True])) | edge[1:]) if len(data) else space
    ends = np.flatnonzero(stop) + 1
    size = ends - starts
    low = _LOWER[data] if lower else data
    h = np.zeros(len(starts), np.uint64)
    alive = np.flatnonzero(size <= _LONG)
    k = 0
    while len(alive):
        h[alive] = h[alive] * _STEP + _BYTE[low[starts[alive] + k]]
        k += 1
        alive = alive[size[alive] > k]
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h + size.astype(np.uint64)), starts, ends


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts of about _CHUNK bytes, one text at least."""
    data, offsets = texts_of(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles, A-Z lower-cased; with fewer words
    the whole sequence as one; without words none."""
    for first, last, data, offsets in chunks(column):
        words, starts, _ = word_hashes(data, offsets)
        at = np.searchsorted(starts, offsets)
        full = max(0, len(words) - k + 1)
        total = np.zeros(full, np.uint64)
        for j in range(k):
            total += words[j : j + full] * _PLACE[j]
        total = mix(total)
        for r in range(last - first):
            a, b = at[r], at[r + 1]
            if b - a >= k:
                yield np.unique(total[a : b - k + 1])
            elif b > a:
                yield mix(np.sum(words[a:b] * _PLACE[: b - a], keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
