"""Vectorised scans over Arrow text columns, shared by the corpus operators.

Everything here works on the UTF-8 bytes of a whole batch of texts at once: one
``uint8`` buffer plus document offsets.  Hashes are polynomial prefix sums modulo
2**64 over random byte values, so the hash of any byte range is two array reads.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Fixed seeds: hashes must agree between executors and between runs.
_RNG = np.random.default_rng(20240607)
_VALUES = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASES = (0x9E3779B97F4A7C15 | 5, 0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_buffers(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, row after, bytes, offsets)`` for runs of rows of about ``most`` bytes.

    Nulls read as empty.  A single text above ``most`` comes alone and whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        lo, hi = int(offsets[at]), int(offsets[end])
        yield at, end, data[lo:hi], offsets[at : end + 1] - lo
        at = end


def released() -> None:
    """Gives freed memory back: a worker lives on for other tasks, and its executor's memory is shared."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def powers(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the lane's base, and of its inverse, for exponents 0 to n."""
    have = _POWERS.get(lane)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        out = []
        for base in (_BASES[lane], pow(_BASES[lane], -1, 1 << 64)):
            x = np.full(size, base, dtype=U64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = (out[0], out[1])
        if size <= 1 << 21:
            _POWERS[lane] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class RangeHash:
    """Position-independent hashes of byte ranges of one buffer."""

    def __init__(self, data: np.ndarray, lane: int = 0):
        n = len(data)
        up, self.down = powers(n, lane)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(_VALUES[lane][data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def rolling(self, width: int) -> np.ndarray:
        """Hashes of every range of ``width`` bytes, by start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=U64)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + U64(width))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the index of each text's first word (one more at the end)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring keys, by start."""
    n = len(keys)
    if n < width:
        return keys[:0]
    pad = -n % width
    x = np.concatenate([keys, np.full(pad, np.iinfo(keys.dtype).max, keys.dtype)]).reshape(-1, width)
    fore = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], fore[width - 1 : n])
