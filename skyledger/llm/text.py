"""Words of whole texts, found and hashed as numpy arrays over UTF-8 bytes.

Word characters are told apart byte by byte: all bytes of a character outside
ASCII are 0x80 or more, so a table of 256 entries is exact for both word rules.
Memory follows the slice of texts handed in, see `byte_slices`; the wide hash
arrays exist for one block of about a megabyte at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20


def _table(outside: list[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[outside] = False
    return table


# [^\x20\x09-\x0D]
NOT_SPACE = _table([0x20, *range(0x09, 0x0E)])
# [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case
ALPHANUMERIC = _table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20250117).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_LETTERS = _LETTERS[LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_POWERS = _powers(_BASE, BLOCK + 1)
_BACK = _powers(_INVERSE, BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; NULL counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return memory that is free but held for later use to the system: a worker outlives its tasks, and the driver its steps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most `limit` bytes of text, or one row; after the last, memory no longer used is given back."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    row, n = 0, len(sizes)
    while row < n:
        before = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(row, stop - row)
        row = stop
    give_back()


def word_spans(data: np.ndarray, offsets: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of the first word of each text (one more at the end)."""
    n = len(data)
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = rule[data]
    opens = inside[:n].copy()
    opens[1:] &= ~inside[: n - 1]
    firsts = offsets[:-1][offsets[:-1] < n]
    opens[firsts] = inside[firsts]
    closes = inside[:n] & ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    closes[lasts] = inside[lasts]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; with `lower`, A-Z count as a-z."""
    letters = _LOWER_LETTERS if lower else _LETTERS
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK, side="right")))
        size = int(ends[j - 1] - low)
        powers, back = (_POWERS, _BACK) if size < len(_POWERS) else (_powers(_BASE, size + 1), _powers(_INVERSE, size + 1))
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(letters[data[low : low + size]] * powers[:size], out=sums[1:])
        at = starts[i:j] - low
        out[i:j] = (sums[ends[i:j] - low] - sums[at]) * back[at]
        i = j
    return mix(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each word on; windows over the end of a text are the caller's to leave out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total *= np.uint64(_BASE)
        total += words[j : j + n]
    return mix(total + np.uint64(size))


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the words that start a whole window inside their text."""
    if first[-1] < size:
        return np.empty(0, np.int64)
    marks = np.zeros(first[-1] + 1, dtype=np.int64)
    np.add.at(marks, first[:-1], 1)
    np.add.at(marks, np.maximum(first[1:] - size + 1, first[:-1]), -1)
    return np.flatnonzero(np.cumsum(marks) > 0)
