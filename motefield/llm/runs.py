"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of consecutive words of one text with smallest period q, as long as at
least ``LEAST`` words and ``TIMES`` periods, that no neighbouring word extends. Any number of texts is
worked on together in arrays; words are numbered by text, so nothing matches across texts:

* Suffix tree: suffixes are sorted by prefix doubling, and the names of the blocks of 2^l words are
  kept by level. A node is an interval of the sorted suffixes and a depth; two equal names
  tell equal blocks, so the longest common extension of any two places, forward or backward, takes
  one look per level, and equality of two stretches takes two looks.
* LZ blocks: a block is the longest stretch from its start that also starts earlier, found at the
  nearest sorted suffixes on both sides that start earlier in the text; or one new word.
* Leftmost-covering squares: a square whose leftmost place has its centre in a block ends in
  that block or the next. For each distance from a block's two ends one forward and one backward
  extension give the first square of that root length around that place. All extensions
  together are about three per word.
* Vocabulary: from such a square a walk along suffix links leads to its right rotations, one
  word on and one word shorter, then one word deeper again; it goes on while the text repeats, and
  for one root at most, as it then is back at its first node. Only primitive roots are walked.
* Occurrences: each node reached, once, gives its whole interval of sorted suffixes: the starts of all
  squares of its root length. Consecutive starts of one root length are one run, to its very ends.

The number of squares with primitive roots is at most in the order of n log n, so a text that
is one word throughout costs no more than another of its length.

Null text has no words. Rows that share an id, or have none, are judged each on its own; a text
without runs has null for the greatest one and counts none. Texts are processed whole, each in one
task, whose memory grows with its longest text (about 200 bytes a word); nothing is shuffled. Other
columns are not carried, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least length of a run in words and in periods.
LEAST, TIMES = 24, 3
#: Words that are worked on together; a longer text is worked on alone.
CHUNK = 400_000


class Suffixes:
    """Sorted suffixes of numbered words, and names of their blocks of 2^l words.

    ``word`` must differ between texts; ``stop`` is the end of each place's text.
    """

    def __init__(self, word: np.ndarray, stop: np.ndarray):
        n = self.n = len(word)
        self.stop = stop
        self.order = np.argsort(word)
        name = np.empty(n, dtype=np.int32)
        first, alone = _groups(word[self.order])
        name[self.order] = first
        self.levels = [name]
        active = np.flatnonzero(~alone)  # ranks whose suffixes are not told apart yet
        width = 1
        while len(active):
            # a name is the first rank of its group, so a group keeps its ranks while it is sorted
            at, name = self.order[active], self.levels[-1]
            beyond = at + width
            second = np.where(beyond < stop[at], name[np.minimum(beyond, n - 1)], -1)
            pair = name[at].astype(np.int64) * (n + 1) + second + 1
            inner = np.argsort(pair)
            at = self.order[active] = at[inner]
            first, alone = _groups(pair[inner])
            name = name.copy()
            name[at] = active[first]
            self.levels.append(name)
            active = active[~alone]
            width *= 2
        self.rank = np.empty(n, dtype=np.int32)
        self.rank[self.order] = np.arange(n, dtype=np.int32)

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` >= 1 words from ``a`` and from ``b`` are equal; both must lie in the array.

        Blocks that reach past the end of their text equal no other block, as their names are theirs alone.
        """
        level = np.minimum(np.frexp(size.astype(np.float64))[1] - 1, len(self.levels) - 1)
        out = np.zeros(len(a), dtype=bool)
        for depth in np.unique(level):
            pick = np.flatnonzero(level == depth)
            names, x, y, back = self.levels[depth], a[pick], b[pick], size[pick] - (1 << int(depth))
            # at the last level no two places share a name, so there longer stretches are told apart too
            out[pick] = (names[x] == names[y]) & (names[x + back] == names[y + back])
        return out

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from ``a`` and ``b`` on, for a <> b, both < n."""
        a, b = a.copy(), b.copy()
        total = np.zeros(len(a), dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            names = self.levels[depth]
            inside = (a < self.n) & (b < self.n)
            step = np.where(inside & (names[np.minimum(a, self.n - 1)] == names[np.minimum(b, self.n - 1)]), 1 << depth, 0)
            total += step
            a += step
            b += step
        return total

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from ``a`` and ``b`` backward, these included; 0 where one is negative."""
        a, b = a + 1, b + 1
        total = np.zeros(len(a), dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            names, width = self.levels[depth], 1 << depth
            inside = (a >= width) & (b >= width)
            step = np.where(inside & (names[np.maximum(a - width, 0)] == names[np.maximum(b - width, 0)]), width, 0)
            total += step
            a -= step
            b -= step
        return total

    def interval(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node of depth ``size`` on the path of each suffix: its first rank and the one behind its last."""
        low, high = np.zeros(len(at), dtype=np.int64), self.rank[at].astype(np.int64)
        first = self._edge(at, size, low, high)
        low, high = self.rank[at].astype(np.int64) + 1, np.full(len(at), self.n, dtype=np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            equal = self._has(self.order[middle], at[open_], size[open_])
            low[open_] = np.where(equal, middle + 1, low[open_])
            high[open_] = np.where(equal, high[open_], middle)
        return first, low

    def _edge(self, at: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            equal = self._has(self.order[middle], at[open_], size[open_])
            high[open_] = np.where(equal, middle, high[open_])
            low[open_] = np.where(equal, low[open_], middle + 1)
        return low

    def _has(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        room = self.stop[a] - a >= size
        return room & self.same(np.where(room, a, b), b, size)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: the first place of each value's group, and whether the value is alone in it."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(values)))
    return np.repeat(first, size), np.repeat(size == 1, size)


def previous_factors(suffixes: Suffixes, repeated: np.ndarray) -> np.ndarray:
    """For each place the length of the longest stretch from it that also starts earlier in its text.

    Places leave the list of sorted suffixes from the last one on; the neighbours of a place that
    leaves are the nearest suffixes on both sides that start earlier.
    """
    places = np.flatnonzero(repeated)
    m = len(places)
    number = np.empty(suffixes.n, dtype=np.int64)
    number[places] = np.arange(m)
    line = number[suffixes.order[repeated[suffixes.order]]]
    left, right = np.full(m + 1, m), np.full(m + 1, m)
    left[line[1:]], right[line[:-1]] = line[:-1], line[1:]
    before, after = left.tolist(), right.tolist()
    for i in range(m - 1, -1, -1):
        a, b = before[i], after[i]
        after[a], before[b] = b, a
    longest = np.zeros(suffixes.n, dtype=np.int64)
    for side in (before, after):
        near = np.array(side[:m], dtype=np.int64)
        some = np.flatnonzero(near < m)
        at, earlier = places[some], places[near[some]]
        longest[at] = np.maximum(longest[at], suffixes.forward(at, earlier))
    return longest


def blocks(longest: np.ndarray) -> np.ndarray:
    """Starts of the blocks; a text's first block starts where its text does, as no earlier place matches it."""
    jump = (np.arange(len(longest)) + np.maximum(longest, 1)).tolist()
    starts, at, n = [], 0, len(longest)
    while at < n:
        starts.append(at)
        at = jump[at]
    return np.array(starts, dtype=np.int64)


def covering_squares(suffixes: Suffixes, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of squares among whose rotations to the right every square's leftmost place is.

    ``first`` is the start of each place's text.
    """
    n, name = suffixes.n, suffixes.levels[0]
    ends = np.append(starts[1:], n)
    size = ends - starts
    text_end = suffixes.stop[starts]
    following = np.append(size[1:], 0)
    following[ends == text_end] = 0
    found = []
    # squares that start in the block: the centre is k words before the block's end
    k = _counted(size)
    h1 = np.repeat(ends, size)
    q = h1 - k
    pick = np.flatnonzero(h1 < suffixes.stop[q])
    pick = pick[name[h1[pick]] == name[q[pick]]]
    k, h1, q = k[pick], h1[pick], q[pick]
    k1 = suffixes.forward(h1, q)
    k2 = np.minimum(suffixes.backward(h1 - 1, q - 1), q - first[q])
    good = k1 + k2 >= k
    found.append((np.maximum(q - k2, q - k + 1)[good], k[good]))
    # squares that start before the block: the centre is in it
    reach = np.minimum(size + following, text_end - starts - 1)
    reach[starts == first[starts]] = 0
    k = _counted(reach)
    h = np.repeat(starts, reach)
    q = h + k
    pick = np.flatnonzero(name[h] == name[q])
    pick = pick[name[h[pick] - 1] == name[q[pick] - 1]]
    end = np.repeat(ends, reach)[pick]
    k, h, q = k[pick], h[pick], q[pick]
    k1 = suffixes.forward(h, q)
    k2 = np.minimum(suffixes.backward(h - 1, q - 1), h - first[h])
    start = np.maximum(h - k2, h - k + 1)
    good = (k1 + k2 >= k) & (start + k <= end)
    found.append((start[good], k[good]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _counted(size: np.ndarray) -> np.ndarray:
    """1 ... size of each block in one array."""
    total = int(size.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(size) - size, size) + 1


_FACTOR = np.zeros(0, dtype=np.int32)


def least_factors(n: int) -> np.ndarray:
    """The least prime factor of each number up to n at least."""
    global _FACTOR
    if len(_FACTOR) <= n:
        size = max(n + 1, 1 << 16)
        factor = np.arange(size, dtype=np.int32)
        for p in range(2, int(size**0.5) + 1):
            if factor[p] == p:
                part = factor[p * p :: p]
                part[part == np.arange(p * p, size, p, dtype=np.int32)] = p
        _FACTOR = factor
    return _FACTOR


def primitive(suffixes: Suffixes, start: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Whether the root of each square is no repetition of a shorter one."""
    keep = np.ones(len(root), dtype=bool)
    if not len(root):
        return keep
    factor = least_factors(int(root.max()))
    rest = root.copy()
    while len(open_ := np.flatnonzero(keep & (rest > 1))):
        p = factor[rest[open_]]
        part = root[open_] // p
        keep[open_] = ~suffixes.same(start[open_], start[open_] + part, root[open_] - part)
        rest[open_] //= p
    return keep


def runs(word: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of all texts, by start and period.

    ``word`` holds the words' numbers, different ones in different texts; ``bounds`` the texts' starts
    and the end. Starts count from the first text's first word.
    """
    n = len(word)
    none = np.zeros(0, dtype=np.int64)
    if not n:
        return none, none, none
    sizes = np.diff(bounds)
    first, stop = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    suffixes = Suffixes(word, stop)
    counts = np.bincount(suffixes.levels[0], minlength=n)
    repeated = counts[suffixes.levels[0]] > 1
    start, root = covering_squares(suffixes, blocks(previous_factors(suffixes, repeated)), first)
    keep = primitive(suffixes, start, root)
    start, root = start[keep], root[keep]
    if not len(start):
        return none, none, none
    # walk to the right rotations while the square's own place repeats, for one root at most
    steps = np.minimum(suffixes.forward(start, start + root) - root, root - 1)
    walk = _counted(steps + 1) - 1
    start, root = np.repeat(start, steps + 1) + walk, np.repeat(root, steps + 1)
    low, high = suffixes.interval(start, 2 * root)
    _, once = np.unique(low * (n + 1) + root, return_index=True)
    low, high, root = low[once], high[once], root[once]
    size = high - low
    places = suffixes.order[np.repeat(low, size) + _counted(size) - 1].astype(np.int64)
    period = np.repeat(root, size)
    order = np.lexsort((places, period))
    places, period = places[order], period[order]
    new = np.ones(len(places), dtype=bool)
    new[1:] = (period[1:] != period[:-1]) | (places[1:] != places[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(places)) - 1
    start, period = places[begin], period[begin]
    length = places[last] - start + 2 * period
    keep = length >= np.maximum(least, times * period)
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


class _Numbers(dict):
    """Words by number, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def text_runs(texts: list[str], least: int = LEAST, times: int = TIMES) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, runs) of each text in order; runs as rows of start, length and period."""
    at = 0
    while at < len(texts):
        words, numbers, bounds, seen = [], [], [0], 0
        while at < len(texts) and (not words or bounds[-1] < CHUNK):
            own = (texts[at] or "").encode().split()  # bytes split at exactly the bytes 9-13 and 32
            table = _Numbers()
            numbers.append(np.fromiter(map(table.__getitem__, own), dtype=np.int64, count=len(own)) + seen)
            seen += len(table)
            words.append(own)
            bounds.append(bounds[-1] + len(own))
            at += 1
        edges = np.array(bounds, dtype=np.int64)
        start, length, period = runs(np.concatenate(numbers), edges, least, times)
        cut = np.searchsorted(start, edges)
        for i, own in enumerate(words):
            part = slice(cut[i], cut[i + 1])
            yield own, np.stack([start[part] - edges[i], length[part], period[part]], axis=1)


def dropped_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words a run holds behind its first period."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 0] + found[:, 1], -1)
    return np.cumsum(steps[:n]) > 0


def _rows(docs: DataFrame, key: str, text: Column | None) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(key), F.coalesce(F.col("text") if text is None else text, F.lit("")).alias("_text"))
    return rows, f"`{key}` {docs.schema[key].dataType.simpleString()}"


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: Column | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``key``, ``start``, ``length``, ``period`` of every run, and ``root``, the words of its first period."""
    rows, field = _rows(docs, key, text)
    names = [key, "start", "length", "period", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, parts, roots = [], [np.zeros((0, 3), dtype=np.int64)], []
            for i, (words, found) in enumerate(text_runs(batch.column(1).to_pylist(), least, times)):
                owner += [i] * len(found)
                parts.append(found)
                roots += [b" ".join(words[s : s + p]).decode() for s, _, p in found]
            table = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(table[:, c]) for c in range(3)), pa.array(roots, pa.string())], names)

    return rows.mapInArrow(run, f"{field}, start long, length long, period long, root string")


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: Column | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per row of ``docs``: ``key``; ``n_runs``; ``start``, ``length``, ``period`` and ``exponent_milli``
    of the run with the greatest length by period (ties: smallest start, then period; nulls without runs);
    ``runs``, each ``start,length,period`` and a line feed; ``collapsed``, the words left, joined by a space,
    when each run keeps its first period only."""
    rows, field = _rows(docs, key, text)
    names = [key, "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _collapsed(batch.column(1).to_pylist(), least, times)
            longs = [pa.array(c, pa.int64()) for c in columns[:5]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(columns[5], pa.string()), pa.array([c.decode() for c in columns[6]], pa.string())], names)

    return rows.mapInArrow(run, f"{field}, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string")


def run_digests(docs: DataFrame, key: str = "doc_id", text: Column | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``collapse_runs`` with the SHA-256 of ``runs`` and ``collapsed``, taken where they are made."""
    rows, field = _rows(docs, key, text)
    names = [key, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _collapsed(batch.column(1).to_pylist(), least, times)
            longs = [pa.array(c, pa.int64()) for c in columns[:5]]
            digests = [[hashlib.sha256(c).hexdigest() for c in column] for column in ([r.encode() for r in columns[5]], columns[6])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, *(pa.array(d, pa.string()) for d in digests)], names)

    return rows.mapInArrow(run, f"{field}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def _collapsed(texts: list[str], least: int, times: int) -> list[list]:
    columns: list[list] = [[] for _ in range(7)]
    for words, found in text_runs(texts, least, times):
        kept, best = words, (None, None, None, None)
        if len(found):
            drop = dropped_words(len(words), found)
            kept = [w for w, gone in zip(words, drop.tolist(), strict=True) if not gone]
            best = _greatest(found)
        written = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
        for column, value in zip(columns, (len(found), *best, written, b" ".join(kept)), strict=True):
            column.append(value)
    return columns


def _greatest(found: np.ndarray) -> tuple[int, int, int, int]:
    """The run of the greatest length by period, compared exactly; of equal ones the first by start, then period."""
    best = found[0].tolist()
    for row in found[1:].tolist():
        if row[1] * best[2] > best[1] * row[2]:
            best = row
    return best[0], best[1], best[2], 1000 * best[1] // best[2]
