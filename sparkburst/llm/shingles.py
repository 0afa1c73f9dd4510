"""Word shingles of whole Arrow string columns, hashed without making Python strings.

Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z, nothing else is
folded. UTF-8 keeps these bytes out of multi-byte characters, so all of this works on the
column's byte buffer. A shingle is ``k`` following words; a text of fewer words has its whole
word sequence as its only shingle, a text of none (or null) has no shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A well-mixed number for each byte at each of 256 places; a word's hash adds those of its bytes.
_CODES = mix64(mix64(np.arange(1 << 16, dtype=np.uint64) + _BASE))


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: empty) and the row offsets into them."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in row order, and the row offsets into them."""
    raw, ends = utf8_buffer(column)
    rows = len(ends) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = ends[:-1][ends[:-1] < len(raw)]
    first[starts] = inside[starts]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    where = np.flatnonzero(inside)
    length = np.diff(np.append(np.searchsorted(where, at), len(where)))
    place = np.arange(len(where)) - np.repeat(np.cumsum(length) - length, length)
    value = _CODES[_FOLD[raw[where]].astype(np.int64) | (place & 255) << 8]
    far = np.flatnonzero(place > 255)
    value[far] *= mix64((place[far] >> 8).astype(np.uint64) + _STEP) | np.uint64(1)
    sums = np.add.reduceat(value, np.cumsum(length) - length)
    return mix64(sums ^ (length.astype(np.uint64) * _STEP)), np.searchsorted(at, ends)


def shingle_hashes(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in row order, repeats kept, and the row offsets into them."""
    words, ends = word_hashes(column)
    count = np.diff(ends)
    out = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    to = np.concatenate(([0], np.cumsum(out)))
    if not to[-1]:
        return np.zeros(0, np.uint64), to
    start = np.repeat(ends[:-1] - to[:-1], out) + np.arange(to[-1])
    width = np.repeat(np.minimum(count, k), out)
    total = np.zeros(len(start), np.uint64)
    for j in range(k):
        held = j < width
        total[held] = total[held] * _STEP + words[start[held] + j]
    return mix64(total ^ (width.astype(np.uint64) * _BASE)), to


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The distinct shingle hashes of every row, ascending."""
    all_, to = shingle_hashes(column, k)
    return [np.unique(all_[a:b]) for a, b in zip(to[:-1], to[1:])]
