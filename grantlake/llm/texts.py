"""Words of Arrow text columns as numpy arrays, and 64-bit hashes of words and of runs of words.

A word is a longest run of bytes other than the space and 0x09-0x0D. Everything is worked out for
a slice of whole texts at a time; slices are bounded by bytes, or hold one text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19  # a slice takes some fifty times its bytes while it is hashed
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_RUN_MULTIPLIER = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table grows with the longest slice seen."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        _powers[base] = have = np.cumprod(table, dtype=np.uint64)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits (a 64-bit finaliser)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts sum to at most ``limit`` bytes (one row at least)."""
    sizes = pa.compute.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    release()


def release() -> None:
    """Give freed memory back to the system. Arrow's pool and numpy's heap else keep what the largest batch took
    for as long as the Python worker lives, idle or not."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Words:
    """The words of a slice: ``data[start[i]:end[i]]`` is word i; text t has words first[t]..first[t+1]-1."""

    def __init__(self, column: pa.Array, lower: bool):
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.data = LOWER[data] if lower else data
        bounds = (offsets - offsets[0]) if len(offsets) else np.zeros(1, np.int64)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        before = np.concatenate(([True], blank[:-1])) | edge[:-1] if len(data) else np.zeros(0, bool)
        after = np.concatenate((blank[1:], [True])) | edge[1:] if len(data) else np.zeros(0, bool)
        self.start = np.flatnonzero(~blank & before)
        self.end = np.flatnonzero(~blank & after) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.texts = len(column)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, from a polynomial over its bytes and its length."""
        base = _MULTIPLIER[which]
        n = len(self.data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[which][self.data] * powers(base, n), out=total[1:])
        value = (total[self.end] - total[self.start]) * powers(inverse(base), n + 1)[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64) * np.uint64(base))


def run_hashes(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``length`` consecutive entries (runs may cross texts; the caller picks)."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    base = _RUN_MULTIPLIER[which]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(base, n), out=total[1:])
    value = (total[length:] - total[:-length]) * powers(inverse(base), n + 1)[: n - length + 1]
    return mix(value + np.uint64(length))


def fold_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole sequence."""
    return run_hashes(hashes, len(hashes))[0]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated start, start+1, ... for each (start, count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)
