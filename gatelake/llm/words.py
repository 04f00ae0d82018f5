"""Vectorised word and shingle hashing on the UTF-8 bytes of Arrow text columns.

Everything here works on whole texts. Rows are taken in blocks of bounded bytes, and a text longer than a block is
cut into pieces at word ends, so memory follows the block and the number of words, not a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word when punctuation is ignored: ASCII other than letters and digits.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = True
for _first, _last in (("0", "9"), ("a", "z"), ("A", "Z")):
    PUNCTUATION[ord(_first):ord(_last) + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, np.uint64(inverse), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(1 << 16)


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if n > len(_UP):
        _UP, _DOWN = _powers(max(n, 2 * len(_UP)))
    return _UP[:n], _DOWN[:n]


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) for blocks of rows; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, row_offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; a row's end ends its last word."""
    inside = ~separators[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    previous = np.empty_like(inside)
    previous[0] = False
    previous[1:] = inside[:-1]
    cuts = row_offsets[(row_offsets > 0) & (row_offsets < len(data))]
    first = inside & ~previous
    first[cuts] |= inside[cuts]
    starts = np.flatnonzero(first)
    last = np.empty_like(inside)
    last[-1] = inside[-1]
    last[:-1] = inside[:-1] & ~inside[1:]
    last[cuts - 1] |= inside[cuts - 1]
    return starts, np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: differences of one running polynomial sum, scaled back to position zero."""
    hashes = np.empty(len(starts), np.uint64)
    position = 0
    while position < len(starts):
        base = int(starts[position])
        stop = max(position + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
        part = data[base:int(ends[stop - 1])]
        up, down = _power_arrays(len(part) + 1)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_VALUES[part] * up[:-1], out=total[1:])
        s, e = starts[position:stop] - base, ends[position:stop] - base
        hashes[position:stop] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _STEP
        position = stop
    return mix(hashes)


def windows(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words; fewer words are one window of their own length."""
    n = len(word_hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(n, k)
    h = np.full(n - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        h = h * _STEP + word_hashes[i:n - width + 1 + i]
    return mix(h)


def row_words(column: pa.Array, separators: np.ndarray = SPACES, lower: np.ndarray | None = LOWER):
    """(row, word hashes) of every row of a column, in order."""
    for first, end, data, offsets in text_blocks(column):
        if lower is not None:
            data = lower[data]
        starts, ends = word_bounds(data, offsets, separators)
        hashes = span_hashes(data, starts, ends)
        cuts = np.searchsorted(starts, offsets)
        for i in range(end - first):
            yield first + i, hashes[cuts[i]:cuts[i + 1]]
