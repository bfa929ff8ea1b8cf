"""Words and word windows of Arrow string columns, as numpy arrays of 64-bit hashes.

Everything is computed from the column's own byte buffer, a few megabytes at a
time, so no Python object is made for a word. A null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library: it keeps what it will
    _LIBC = None
_LONG = 1 << 12
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)

_rng = np.random.RandomState(20240229)
_BYTE = (_rng.randint(0, 1 << 32, 256, dtype=np.uint64) << np.uint64(32)) | _rng.randint(0, 1 << 32, 256, dtype=np.uint64)
_BYTE[0] = 0
_PLACE = ((_rng.randint(0, 1 << 32, _LONG, dtype=np.uint64) << np.uint64(32)) | _rng.randint(0, 1 << 32, _LONG, dtype=np.uint64)) | np.uint64(1)


def _fold(word_bytes) -> np.ndarray:
    """A table from byte to folded byte; 0 for a byte that ends a word."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        if word_bytes(b):
            table[b] = b + 32 if 65 <= b <= 90 else b
    table[0] = 0
    return table


#: Words are runs of anything but a space and \x09-\x0D. NUL cannot fold to 0, so it takes a byte that UTF-8 never has.
SPACED = _fold(lambda b: b != 32 and not 9 <= b <= 13)
SPACED[0] = 0xFF
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = _fold(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words(NamedTuple):
    """The words of some rows: hash, first byte and byte after the last, and where each row's words begin."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    folded: np.ndarray

    def text(self, i: int) -> bytes:
        return self.folded[self.start[i] : self.end[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a string column; without nulls its bytes aren't copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("", column.type))
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Gives freed memory back to the system: Python workers live on from task to task, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about ``most`` bytes, or one row."""
    data, off = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    if len(data) > most:
        release()


def words(data: np.ndarray, off: np.ndarray, fold: np.ndarray) -> Words:
    folded = fold[data]
    inside = folded != 0
    n, rows = len(folded), len(off) - 1
    breaks = off[1:-1]
    breaks = breaks[breaks < n]
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        before[breaks] = False
    start = np.flatnonzero(inside & ~before)
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, np.zeros(rows + 1, np.int64), folded)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[breaks - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    low = start[0]
    place = np.arange(low, n) - np.repeat(start, np.diff(np.append(start, n)))
    h = np.add.reduceat(_BYTE[folded[low:]] * _PLACE[place & (_LONG - 1)], start - low)
    h = mix(h ^ (end - start).astype(np.uint64))
    return Words(h, start, end, np.searchsorted(start, off), folded)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words of one row, and the index of its first word."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h += mix(w.hash[j : n - k + 1 + j] + np.uint64(j)) * _PLACE[j + 1]
    h = mix(h)
    row_end = np.repeat(w.first[1:], np.diff(w.first))
    at = np.flatnonzero(np.arange(n - k + 1) + k <= row_end[: n - k + 1])
    return h[at], at


def run_hash(h: np.ndarray) -> np.uint64:
    """Hash of one whole run of words, as ``windows`` would give it for that length."""
    out = np.zeros(1, np.uint64)
    for j, x in enumerate(h):
        out += mix(np.asarray([x], np.uint64) + np.uint64(j)) * _PLACE[(j + 1) % _LONG]
    return mix(out)[0]
