"""Vectorised text kernels on Arrow string buffers (numpy, no per-word Python).

Texts are read as UTF-8 bytes in place. A word is a run of bytes outside the six ASCII
white-space bytes, which equals the code-point class ``[^\\x20\\x09-\\x0D]+`` because UTF-8
continuation bytes are never below 0x80. Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters and digits, and every byte of a non-ASCII character.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False

_pows: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pows or len(_pows[0]) < n:
        size = max(n, _CHUNK + 1)
        steps = np.full(size, _BASE, U64)
        steps[0] = 1
        back = np.full(size, _INV, U64)
        back[0] = 1
        _pows[:] = [np.cumprod(steps), np.cumprod(back)]
    return _pows[0], _pows[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Hasher:
    """64-bit hashes of byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray):
        up, self.back = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Chunk:
    """Some consecutive rows: ``rows`` are their indexes in the batch, row i is buf[off[i]:off[i+1]]."""

    rows: np.ndarray
    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.rows)

    def words(self, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and for each row the index of its first word."""
        n = len(self.buf)
        inside = ~separators[self.buf]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return start, end, np.searchsorted(start, self.off)

    def code_points(self) -> np.ndarray:
        """counts[i] code points lie before byte i."""
        out = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=out[1:])
        return out


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off.astype(np.int64)


_calls = 0


def trim() -> None:
    """Gives a worker's freed memory back now and then; numpy's buffers would stay with the process."""
    global _calls
    _calls += 1
    if _calls % 8:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def chunks(column: pa.Array, size: int = _CHUNK) -> Iterator[Chunk]:
    """The rows in runs of about ``size`` bytes; a longer text is a chunk alone, and whole."""
    n = len(column)
    if not n:
        return
    buf, off = texts(column)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
        to = min(to, n)
        yield Chunk(np.arange(at, to), buf[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to
    trim()


def weights(n: int, salt: int = 0) -> np.ndarray:
    """n odd multipliers without small integer relations: equal sums of words in another order would collide."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x2545F4914F6CDD1D) + U64(salt)) | U64(1)


def windows(h: np.ndarray, first: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive word hashes within each row: hash, index of the first word, and bounds by row."""
    n = len(h)
    count = np.maximum(np.diff(first) - (k - 1), 0)
    bounds = np.zeros(len(first), np.int64)
    np.cumsum(count, out=bounds[1:])
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64), bounds
    acc = np.zeros(n - k + 1, U64)
    for j, w in enumerate(weights(k, salt)):
        acc += h[j : n - k + 1 + j] * w
    ok = np.zeros(n - k + 1, bool)
    at = np.repeat(first[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    ok[at] = True
    return mix(acc[ok]), at, bounds


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=schema)
