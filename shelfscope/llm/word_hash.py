"""Words of whole Arrow batches of texts as 64-bit hashes, by array operations over the batch's bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
PORTION = 4_000_000  # bytes of text handled at once; one longer text is a portion of its own
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE modulo 2**64 and of its inverse, n of each at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        both = []
        for base in (int(BASE), pow(int(BASE), -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers = both[0], both[1]
    return _powers


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; bytes a to b have ``range_hash(prefix, a, b)``."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=prefix[1:])
    return prefix


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def portions(column: pa.Array, most: int = PORTION) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them); null texts have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        stop = min(stop, len(column))
        yield start, stop, whole[at[start] : at[stop]], at[start : stop + 1] - at[start]
        start = stop


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, words before each text and in all). ``letters``: whether a byte is part of a word.

    A-Z are lower-cased. A word never runs on into the next text.
    """
    low = LOWER[data]
    inside = letters[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = mix(range_hash(prefix_hash(low), starts, ends) + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; of all its words if there are fewer, none without words."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    run = np.full(len(hashes) - size + 1, size, np.uint64)
    for j in range(size):
        run = mix(run * BASE + hashes[j : len(hashes) - size + 1 + j])
    return run


def letters(excluded: str) -> np.ndarray:
    """Table of the bytes that make words: all but these ASCII characters."""
    table = np.ones(256, bool)
    table[[ord(c) for c in excluded]] = False
    return table
