"""Word shingles of whole texts as 64-bit hashes, vectorised over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes and texts that are hashed together; work arrays take some sixty bytes a byte, and what callers make of a text some 40 KB.
_CHUNK, _TEXTS = 1 << 18, 256
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE = _BYTE[_LOWER]
_BYTE[_SPACE] = 0
_PLACE = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, dtype=np.uint64))
_STEP = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, over a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts data[bounds[i]:bounds[i+1]], with the offsets of each text's run."""
    n = len(bounds) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    word = ~_SPACE[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    inner = bounds[:-1]
    before[inner[inner < len(data)]] = False
    first = word & ~before
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    at = np.arange(len(data)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    words = mix(np.add.reduceat(_BYTE[data] * _PLACE[at & 0xFFFF], starts))
    upto = np.searchsorted(starts, bounds)
    count = np.diff(upto)
    grams = np.zeros(len(words), np.uint64)
    for j in range(min(WIDTH, len(words))):
        grams[: len(words) - j] += words[j:] * _STEP[j]
    keep = np.arange(len(words)) + WIDTH <= np.repeat(upto[1:], count)
    short = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(short):
        at, left = upto[short], count[short]
        whole = left.astype(np.uint64) << np.uint64(48)
        for j in range(WIDTH - 1):
            has = left > j
            whole[has] += words[at[has] + j] * _STEP[j]
        grams[at] = whole
        keep[at] = True
    sizes = np.where(count >= WIDTH, count - WIDTH + 1, (count > 0).astype(np.int64))
    return mix(grams[keep]), np.concatenate([[0], np.cumsum(sizes)])


def text_shingles(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For runs of rows: (first row, the sorted distinct shingle hashes of each).

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; five words make a shingle, fewer words
    make one of the whole sequence; null, empty and blank texts have none.
    """
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    size = len(column)
    if not size:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + size + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    i = 0
    while i < size:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
        j = min(j, size, i + _TEXTS)
        grams, runs = _shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out = []
        for k in range(j - i):
            part = np.sort(grams[runs[k] : runs[k + 1]])
            out.append(part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) > 1 else part)
        yield i, out
        i = j
