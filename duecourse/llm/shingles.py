"""Hashes of words and word shingles, vectorised over the bytes of an Arrow text column.

A word is a run of anything but ASCII white space, A-Z taken as a-z. Words hash to 64 bits over
their bytes; a shingle of ``width`` words hashes over its words' hashes. A text with fewer words
(but at least one) has one shingle, made of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.arange(1, 257, dtype=np.uint64)
_BYTE[65:91] += np.uint64(32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are worked on at once; the arrays made for them take about 40 times as much.
PIECE = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole texts as (bytes, offsets); a text longer than ``limit`` comes alone."""
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    offsets = np.frombuffer(column.buffers()[1] or b"", dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        at = offsets[first : last + 1]
        yield data[at[0] : at[-1]], at - at[0]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the place of each text's first word among them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    borders = offsets[:-1][offsets[:-1] < len(data)]
    start[borders] = inside[borders]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(start) - 1, 0)]
    place[~inside] = 0
    top = int(place.max()) + 1
    powers = _POWERS if top <= len(_POWERS) else _powers(top)
    values = _BYTE[data] * powers[place]
    values[~inside] = 0
    return mixed(np.add.reduceat(values, starts)), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text in order its distinct shingle hashes, ascending; empty for null or blank."""
    for data, offsets in pieces(column):
        hashes, firsts = word_hashes(data, offsets)
        every = hashes[: max(len(hashes) - width + 1, 0)].copy()
        for k in range(1, width):
            every *= _SHINGLE
            every += hashes[k : k + len(every)]
        every = mixed(every)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(every[a : b - width + 1])
            elif b > a:
                short = np.uint64(b - a)
                for h in hashes[a:b]:
                    short = _join(short, h)
                yield mixed(np.array([short], dtype=np.uint64))
            else:
                yield hashes[:0]


def _join(seed: np.uint64, word: np.uint64) -> np.uint64:
    """One step of the hash of a short text; its length seeds it, so it meets no full shingle."""
    return np.uint64((int(seed) * int(_SHINGLE) + int(word) + 0x632BE5AB) & 0xFFFFFFFFFFFFFFFF)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums that stand for a set."""
    one = mixed(shingles ^ _MIX1).sum(dtype=np.uint64)
    two = mixed(shingles + _STEP).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))
