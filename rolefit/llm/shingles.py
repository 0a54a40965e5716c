"""Word shingles of many texts at once, as 64-bit hashes, in numpy over the bytes of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multiplier of the byte polynomial, its inverse modulo 2**64, and mixing constants (of splitmix64).
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the ends of its rows (n + 1 numbers from 0); null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words of each row."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = blank[:-1]
    edge[ends] = True  # a row starts a word of its own
    starts = np.flatnonzero(edge[:-1] & ~blank)
    stop = np.ones(len(data) + 1, bool)
    stop[:-1] = blank
    stop[ends] = True
    stops = np.flatnonzero(stop)
    stops = stops[np.searchsorted(stops, starts, side="right")]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(ends) - 1, np.int64)
    run = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)))])
    value = (run[stops] - run[starts]) * powers(INVERSE, len(data))[starts]
    return mixed(value), np.diff(np.searchsorted(starts, ends))


def text_keys(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One key per row from its words in order; 0 for a row without words."""
    first = np.cumsum(counts) - counts
    place = np.arange(len(words)) - np.repeat(first, counts)
    weight = powers(BASE, int(counts.max(initial=0)) + 1)[place + 1]
    keys = np.zeros(len(counts), np.uint64)
    some = counts > 0
    if some.any():
        keys[some] = mixed(np.add.reduceat(words * weight, first[some]) + counts[some].astype(np.uint64))
    return keys


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each row, and their numbers; a shorter row is one run of all its words."""
    weight = powers(BASE, size + 1)[1:]
    runs = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    first = np.repeat(np.cumsum(counts) - counts, runs)
    start = first + np.arange(len(first)) - np.repeat(np.cumsum(runs) - runs, runs)
    left = np.repeat(np.minimum(counts, size), runs)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    total = left.astype(np.uint64)
    for j in range(size):
        total = total + np.where(left > j, padded[start + j], np.uint64(0)) * weight[j]
    return mixed(total), runs
