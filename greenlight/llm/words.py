"""Words of Arrow text columns as arrays of 64-bit hashes, without a Python object per word.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage
return, after lower-casing A-Z. The hash of a word is a polynomial of its bytes modulo 2**64,
read off prefix sums, with its length mixed in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

def lower_latin(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals U+00C0 to U+00DE (C3 80 to C3 9E in UTF-8) lower-cased."""
    out = LOWER[data]
    capital = latin_capital(data)
    out[1:][capital] += 32
    return out


def latin_capital(data: np.ndarray) -> np.ndarray:
    """For each byte but the first: whether it ends one of the capitals U+00C0 to U+00DE."""
    return (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)


BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
SEGMENT = 1 << 20
SLICE = 4 << 20


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    up = np.full(n, BASE, dtype=np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column, most: int = SLICE, most_rows: int = 1 << 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of runs of rows with about ``most`` bytes; a row is never cut."""
    data, offsets = text_buffer(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        stop = min(max(stop, row + 1), rows, row + most_rows)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of its first word (one more at the end)."""
    inner = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = True
    np.logical_not(inner[:-1], out=before[1:])
    starts = np.flatnonzero(inner & (before | first[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1:] = True
    np.logical_not(inner[1:], out=after[:-1])
    ends = np.flatnonzero(inner & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        origin = int(starts[at])
        stop = max(int(np.searchsorted(ends, origin + SEGMENT, side="right")), at + 1)
        piece = data[origin : int(ends[stop - 1])]
        up, down = _powers(1 << max(20, int(len(piece)).bit_length()))
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        s, e = starts[at:stop] - origin, ends[at:stop] - origin
        out[at:stop] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = stop
    return mix(out)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each row the number of its first word (one more at the end)."""
    data = LOWER[data]
    starts, ends, rows = word_bounds(data, offsets)
    return hash_spans(data, starts, ends), rows


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n neighbours, one for each possible first place, read off prefix sums."""
    count = max(0, len(hashes) - n + 1)
    up, down = _powers(1 << max(20, len(hashes).bit_length()))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n : n + count] - sums[:count]) * down[:count])


def row_of(rows: np.ndarray) -> np.ndarray:
    """For each word its row, from the first words of the rows."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that lie within one row, and the row of each."""
    joined = rolling(hashes, n)
    row = row_of(rows)
    inside = row[: len(joined)] == row[n - 1 :] if len(joined) else np.zeros(0, bool)
    return joined[inside], row[: len(joined)][inside]
