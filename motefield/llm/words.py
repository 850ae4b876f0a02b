"""Words of whole Arrow columns as arrays of places and hashes, without a string per word.

A word is a longest run of bytes other than space and the bytes 9 to 13. Its hash is a
polynomial of its bytes modulo 2^64 (differences of one running sum, so any word costs the
same), mixed to 64 bits; two bases give two independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Multipliers and shifts of the mixing step, odd bases of the two polynomials.
MIX_A, MIX_B, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
BASES = (0x5851F42D4C957F2D, 0xDA942042E4DD58B5)
#: Bytes of text that are worked on together; a longer text is worked on alone.
CHUNK = 1 << 20

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def seeded(seed: int) -> np.uint64:
    return mix(np.array([(seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1], dtype=np.uint64))[0]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n at least."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = max(n + 1, CHUNK + 1)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        if n > 4 * CHUNK:
            return pair[0], pair[1]  # for one very long text; not kept
        _POWERS[base] = (pair[0], pair[1])
    return _POWERS[base]


@dataclass
class Words:
    """Words of some texts in order: byte places, the text each is in, and where texts begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words at its end
    rows: slice

    def hashes(self, which: int = 0) -> np.ndarray:
        up, down = powers(BASES[which], len(self.data))
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * GOLDEN)


def chunks(texts: pa.Array) -> Iterator[Words]:
    """The words of a string column that has no nulls, some texts at a time."""
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=n + 1, offset=4 * texts.offset).astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, side="right")) - 1)
        yield _words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], slice(low, high))
        low = high


def _words(data: np.ndarray, bounds: np.ndarray, rows: slice) -> Words:
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    begin, end = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    doc = np.searchsorted(bounds, start, side="right") - 1
    first = np.searchsorted(start, bounds)
    return Words(data, start, stop, doc, first, rows)


def text_column(batch: pa.RecordBatch, at: int) -> pa.Array:
    column = batch.column(at)
    return column.cast(pa.string()) if column.type != pa.string() else column
