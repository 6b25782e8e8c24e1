"""Array kernels over Arrow text columns.

A batch of texts is handled as one byte array plus document offsets, so that
the per-document work inside a Spark task is a handful of numpy passes rather
than a Python loop over words.  Texts are UTF-8; white space and ASCII letters
are single bytes, hence splitting and case folding work on bytes.

Hashes are polynomial prefix sums modulo 2**64 over randomly mapped bytes,
finished by a multiply-xorshift mixer.  Callers that need certainty combine two
independent ones.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CONTINUATION = np.zeros(256, bool)
CONTINUATION[0x80:0xC0] = True
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of text that one pass works on; a longer document makes one pass of its own.
PASS_BYTES = (1 << 20) - 4096


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each (one more than texts); nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(offs) else np.empty(0, np.uint8)
    return raw, offs - offs[0]


def passes(data: np.ndarray, offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole documents of about ``limit`` bytes: (first, last + 1, bytes, offsets)."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that ``outside`` does not mark; runs end with their document."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~outside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def owner(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Document index of each byte position in ``at``."""
    return np.searchsorted(offsets, at, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks, and its allocators keep what it once held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@functools.lru_cache(maxsize=2)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def ladder(x: int) -> np.ndarray:
        out = np.full(size, x, U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return ladder(base), ladder(pow(base, -1, 1 << 64))


#: Odd multipliers and byte maps of the two polynomial hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MAPS = [np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1) for seed in (11, 23)]


class Prefix:
    """Hash of any substring of ``data`` in constant time."""

    def __init__(self, data: np.ndarray, which: int = 0):
        size = (len(data) + (1 << 20)) >> 20 << 20
        up, self.down = _powers(_BASES[which], size)
        self.sums = np.empty(len(data) + 1, U64)
        self.sums[0] = 0
        np.cumsum(_MAPS[which][data] * up[: len(data)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def windows(values: np.ndarray, group: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` consecutive values of one group: (index of its first value, hash)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U64)
    at = np.flatnonzero(group[:n] == group[size - 1 :])
    out = np.zeros(len(at), U64)
    step = U64(_BASES[which])
    for i in range(size):
        out = out * step + values[at + i]
    return at, mix(out)


def per_group(index: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of whole-number weights, for each of ``n`` groups."""
    if weights is None:
        return np.bincount(index, minlength=n).astype(np.int64)
    return np.bincount(index, weights=weights, minlength=n).astype(np.int64)


def take_ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of ranges ``starts[i] : starts[i] + lengths[i]``."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return x.view(np.int64)
