"""Words of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ODD = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse, modulo 2 ^ 64, at least ``n`` of them."""
    if len(_powers[0]) < n:
        for k, base in enumerate((ODD, pow(ODD, -1, 2**64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers so that every bit depends on all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_chunks(column: pa.Array, most: int = 1 << 20):
    """Runs of rows with about ``most`` bytes: first row, offsets of its texts, their bytes.  Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, off[a:b + 1] - off[a], data[off[a]:off[b]]
        a = b


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True
_LETTER[39] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes marked in ``inside``; runs do not cross texts."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[bounds < len(data)]
    first[bounds] = inside[bounds]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:-1] - 1
    ends = ends[ends >= 0]
    last[ends] = inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of ``data[s:e]`` for every pair of bounds."""
    up, down = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return mix((total[e] - total[s]) * down[s])


def letters(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes and the spans of words made of letters, digits and apostrophes."""
    low = _LOWER[data]
    return low, *spans(low, offsets, _LETTER[low])


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Spans of words between white space."""
    return spans(data, offsets, ~_SPACE[data])
