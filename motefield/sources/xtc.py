"""Compressed positions of XTC frames: mixed-radix whole numbers in a stream of bits.

Some atoms are stored as whole places in the frame's bounds, the atoms behind them as small steps from atom to
atom; a flag after each whole place tells whether the number of steps or their width changes. Where an atom
begins follows from the flags alone, so a short loop finds all beginnings and numpy takes all numbers out at once.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: numbers of steps by width index, about 2^(index / 3), and the first index in use.
STEPS = [0] * 9 + [
    8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250,
    4096, 5060, 6501, 8192, 10321, 13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144,
    330280, 416127, 524287, 660561, 832255, 1048576, 1321122, 1664510, 2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388607,
    10568983, 13316085, 16777216,
]
FIRST = 9
#: Fixed value: bounds wider than this are stored by coordinate.
WIDEST = 0xFFFFFF


def _bits(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The numbers of ``size`` bits (32 at most) from each bit place on, the first bit highest."""
    byte = at >> 3
    window = np.zeros(len(at), dtype=np.uint64)
    for k in range(5):
        window = (window << np.uint64(8)) | data[byte + k]
    return ((window >> (np.uint64(40) - (at & 7).astype(np.uint64) - np.uint64(size))) & np.uint64((1 << size) - 1)).astype(np.int64)


def _triples(data: np.ndarray, at: np.ndarray, size: int, radix: np.ndarray) -> np.ndarray:
    """Three numbers each below its radix, packed in ``size`` bits: bytes from the lowest on, the rest last."""
    digits = [_bits(data, at + 8 * k, min(8, size - 8 * k)) for k in range(-(-size // 8))]
    out = np.empty((len(at), 3), dtype=np.int64)
    for axis in (2, 1):
        rest = np.zeros(len(at), dtype=np.int64)
        for k in range(len(digits) - 1, -1, -1):
            digits[k], rest = np.divmod((rest << 8) | digits[k], radix[axis])
        out[:, axis] = rest
    first = np.zeros(len(at), dtype=np.int64)
    for k in range(min(len(digits), 7) - 1, -1, -1):
        first = (first << 8) | digits[k]
    out[:, 0] = first
    return out


def decode_positions(packed: bytes, n: int, low: np.ndarray, high: np.ndarray, small: int) -> np.ndarray:
    """(n, 3) whole places from the packed bytes of a frame with bounds ``low`` to ``high`` and first width ``small``."""
    data = np.frombuffer(packed + bytes(16), dtype=np.uint8)
    radix = high - low + 1
    apart = bool((radix > WIDEST).any())
    widths = [int(r).bit_length() for r in radix]
    whole = sum(widths) if apart else (int(radix[0]) * int(radix[1]) * int(radix[2])).bit_length()
    # the loop over flags: where each whole place begins, and the number and the width of its steps
    raw, at, done, run = packed + bytes(16), 0, 0, 0
    begins, counts, kinds = [], [], []
    limit = 8 * len(packed)
    while done < n:
        if at > limit:
            raise ValueError("a frame's positions break off")
        begins.append(at)
        at += whole
        change = 0
        if raw[at >> 3] >> (7 - (at & 7)) & 1:
            code = int.from_bytes(raw[at + 1 >> 3 : (at + 1 >> 3) + 2]) >> (11 - (at + 1 & 7)) & 31
            change = code % 3
            run = (code - change) // 3
            change -= 1
            at += 5
        at += 1
        if run and not FIRST <= small < len(STEPS):
            raise ValueError("a frame has a width that the format lacks")
        counts.append(run)
        kinds.append(small)
        at += run * small
        done += 1 + run
        small += change
    start, count, kind = np.array(begins, dtype=np.int64), np.array(counts, dtype=np.int64), np.array(kinds, dtype=np.int64)
    if apart:
        ends = np.cumsum([0, *widths])
        base = np.stack([_bits(data, start + int(ends[k]), widths[k]) for k in range(3)], axis=1)
    else:
        base = _triples(data, start, whole, radix)
    base = base + low
    # steps begin behind the flag, and behind the code where there is one
    flag = _bits(data, start + whole, 1)
    first = start + whole + 1 + 5 * flag
    owner = np.repeat(np.arange(len(start)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    place, width = first[owner] + k * kind[owner], kind[owner]
    steps = np.empty((len(owner), 3), dtype=np.int64)
    for index in np.unique(width):
        pick = np.flatnonzero(width == index)
        span = STEPS[index]
        steps[pick] = _triples(data, place[pick], int(index), np.full(3, span, dtype=np.int64)) - span // 2
    total = np.cumsum(steps, axis=0)
    before = np.concatenate((np.zeros((1, 3), dtype=np.int64), total))[np.cumsum(count) - count]
    moved = base[owner] + total - before[owner]
    # the first step's atom stands before the whole place, the others behind it
    out = np.empty((n, 3), dtype=np.int64)
    spot = np.cumsum(1 + count) - (1 + count)
    out[spot + (count > 0)] = base
    out[spot[owner] + np.where(k == 0, 0, k + 1)] = moved
    return out
