"""How the sources of each language differ in their terms, by mergeable radix tries.

* Count: a task throws the terms of its texts into byte tries, one root a language, whose edges
  take eight bytes and whose leaves hold occurrences and documents by source. A node that a
  single place reaches is a leaf at once, whatever is left of its term. Tries of some texts are
  merged as they come; one that has grown to ``LEAVES`` leaves is given away. A row is a
  leaf: language, term, documents, and occurrences by source.
* Merge: Spark deals leaves by ranges of (language, term) and sorts them; a task adds up the
  equal ones in passing and gives the terms that enough documents have, in the order of their
  UTF-8 bytes. However common, a term has one row per trie at most.
* Traverse: each range is read again in that order, behind a line for each of its languages that
  holds the totals of all its sources. They give a term's probability in every source, those that
  lack it included. Sums by pair of sources and the best candidates by source leave the task, ties
  in the order of their bytes. Spark adds the sums and ranks.

Probabilities are whole numbers of ``SCALE``: p = 1 + floor(SCALE (count + 1) / (N + V)), where N counts a
source's kept terms and V a language's. The divergence of p from q is floor((p - q)^2 / q). All of it is
exact in 64 bits while N + V is under 9 x 10^15 and V under 10^9.

Null text, language and source count as empty. Every row is a document, repeated rows too. A
language without kept terms has pairs of value 0; a source that is alone in its language has no
pairs. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.storage import materialize

#: Documents of a language that must have a term; candidates by source that the report ranks.
LEAST_DOCS, TOP = 3, 200
#: Fixed value: the whole of which probabilities are parts.
SCALE = 1_000_000_000
#: Bytes of text that make one trie before it is merged, and leaves at which a trie is given away.
CHUNK, LEAVES = 4 << 20, 1_000_000
#: Numbers in one table of terms by sources; sources whose pair sums a task holds as one table.
CELLS, SQUARE = 1 << 20, 2048
#: Terms that are worth a task of their own in the traversal.
TERMS = 20_000
#: Parts in which candidates are ranked before they are ranked together.
PARTS = 256


@dataclass
class Trie:
    """Leaves in the order of (language, bytes), and their counters in the order of (leaf, source)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lang: np.ndarray
    leaf: np.ndarray
    source: np.ndarray
    count: np.ndarray
    docs: np.ndarray


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first byte highest."""
    out = np.zeros(len(data) + 8, dtype=np.uint64)
    out[: len(data)] = data
    for width in (1, 2, 4):
        out[:-width] = (out[:-width] << np.uint64(8 * width)) | out[width:]
    return out


def _edges(eights: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The next edge of each term that is at ``start``; bytes past its end are 0, which no term has."""
    left = end - start
    spare = np.clip(8 - left, 0, 7).astype(np.uint64) * np.uint64(8)
    return np.where(left > 0, (eights[start] >> spare) << spare, np.uint64(0))


def leaves(data: np.ndarray, start: np.ndarray, end: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, leaf): places in the order of (root, bytes), and the leaf of each place in that order.

    A leaf is named by the first rank of its places. Each round goes one edge down from the nodes
    that several places reach and that are no ends of all of them.
    """
    n = len(start)
    eights = _eights(data)
    edge = _edges(eights, start, end)
    order = np.argsort(edge)
    order = order[np.argsort(root[order], kind="stable")]
    leaf = _first(edge[order], root[order])
    depth = 8
    active = np.arange(n)
    while True:
        # nodes stand together; only those that several places reach, one of them not ending here, go on
        begin = np.unique(_first(leaf[active]))
        size = np.diff(np.append(begin, len(active)))
        longer = end[order[active]] - start[order[active]] > depth
        more = (size > 1) & np.logical_or.reduceat(longer, begin) if len(begin) else size > 1
        active = active[np.repeat(more, size)]
        if not len(active):
            return order, leaf
        at, node = order[active], leaf[active]
        edge = _edges(eights, np.minimum(start[at] + depth, len(data)), end[at])
        inner = np.lexsort((edge, node))
        order[active] = at[inner]
        leaf[active] = active[_first(edge[inner], node[inner])]
        depth += 8


def _first(*columns: np.ndarray) -> np.ndarray:
    """Of sorted rows, the place where each row's group begins."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    begin = np.flatnonzero(new)
    return np.repeat(begin, np.diff(np.append(begin, n)))


def text_trie(data: np.ndarray, bounds: np.ndarray, lang: np.ndarray, source: np.ndarray) -> Trie:
    """The trie of some texts that lie in ``data`` between ``bounds``; language and source by text."""
    capital = (data >= 65) & (data <= 90)
    data = np.where(capital, data | 32, data)
    inside = (data >= 128) | ((data >= 97) & (data <= 122))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    begin, stop = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        stop[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    text = np.searchsorted(bounds, start, side="right") - 1
    order, leaf = leaves(data, start, end, lang[text])
    # texts are numbered by source, so that a leaf's places sorted by text are sorted by source
    by_source = np.argsort(source, kind="stable")
    number = np.empty(len(source), dtype=np.int64)
    number[by_source] = np.arange(len(source))
    keys = np.sort(leaf * len(source) + number[text[order]]) if len(order) else np.zeros(0, dtype=np.int64)
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    node, owner = np.divmod(keys[begin], max(1, len(source)))
    return _trie(data, start, end, lang[text], order, node, source[by_source][owner], np.diff(np.append(begin, len(keys))), np.ones(len(begin), dtype=np.int64))


def _trie(data: np.ndarray, start: np.ndarray, end: np.ndarray, lang: np.ndarray, order: np.ndarray, leaf: np.ndarray, source: np.ndarray, count: np.ndarray, docs: np.ndarray) -> Trie:
    """A trie from counters sorted by leaf and source, equal ones side by side; only the bytes of its leaves are kept."""
    if not len(leaf):
        none = np.zeros(0, dtype=np.int64)
        return Trie(np.zeros(0, dtype=np.uint8), none, none, none, none, none, none, none)
    begin = np.unique(_first(leaf, source))
    names = np.unique(leaf)
    place = order[names]
    size = end[place] - start[place]
    stop = np.cumsum(size)
    held = data[np.repeat(start[place] - (stop - size), size) + np.arange(stop[-1])]
    return Trie(held, stop - size, stop, lang[place], np.searchsorted(names, leaf[begin]), source[begin], np.add.reduceat(count, begin), np.add.reduceat(docs, begin))


def merged(tries: list[Trie]) -> Trie:
    """One trie that counts what all of them count."""
    if len(tries) == 1:
        return tries[0]
    shift = np.cumsum([0] + [len(t.data) for t in tries])
    data = np.concatenate([t.data for t in tries])
    start = np.concatenate([t.start + s for t, s in zip(tries, shift, strict=False)])
    end = np.concatenate([t.end + s for t, s in zip(tries, shift, strict=False)])
    lang = np.concatenate([t.lang for t in tries])
    order, leaf = leaves(data, start, end, lang)
    named = np.empty(len(order), dtype=np.int64)
    named[order] = leaf
    first = np.cumsum([0] + [len(t.start) for t in tries])
    node = named[np.concatenate([t.leaf + f for t, f in zip(tries, first, strict=False)])] if len(order) else leaf
    source, count, docs = (np.concatenate([getattr(t, c) for t in tries]) for c in ("source", "count", "docs"))
    inner = np.lexsort((source, node))
    return _trie(data, start, end, lang, order, node[inner], source[inner], count[inner], docs[inner])


class _Codes(dict):
    """Strings by number, in the order in which they are met."""

    def __missing__(self, value: str) -> int:
        found = self[value] = len(self)
        return found

    def of(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode()
        known = np.array([self[v] for v in coded.dictionary.to_pylist()], dtype=np.int64)
        return known[coded.indices.to_numpy(zero_copy_only=False)] if len(column) else known


_LEAF = "lang string, term string, docs long, sources array<string>, counts array<long>"


def _strings(data: np.ndarray, end: np.ndarray) -> pa.Array:
    """Strings that lie in ``data`` without gaps, each up to its ``end``."""
    bounds = np.concatenate(([0], end)).astype(np.int32)
    return pa.StringArray.from_buffers(len(end), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))


def _rows(trie: Trie, langs: list[str], sources: list[str], step: int = 20_000) -> Iterator[pa.RecordBatch]:
    """A trie's leaves as record batches."""
    n = len(trie.start)
    bounds = np.searchsorted(trie.leaf, np.arange(n + 1))
    docs = np.add.reduceat(trie.docs, bounds[:-1]) if n else trie.docs
    names, lang_names = pa.array(sources, pa.string()), pa.array(langs, pa.string())
    for a in range(0, n, step):
        b = min(n, a + step)
        part = slice(bounds[a], bounds[b])
        offsets = pa.array((bounds[a : b + 1] - bounds[a]).astype(np.int32))
        terms = _strings(trie.data[trie.start[a] : trie.end[b - 1]], trie.end[a:b] - trie.start[a])
        yield pa.RecordBatch.from_arrays(
            [lang_names.take(pa.array(trie.lang[a:b])), terms, pa.array(docs[a:b]), pa.ListArray.from_arrays(offsets, names.take(pa.array(trie.source[part]))), pa.ListArray.from_arrays(offsets, pa.array(trie.count[part]))],
            ["lang", "term", "docs", "sources", "counts"],
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of the tries of (lang, source, text)."""
    langs, sources = _Codes(), _Codes()
    held: list[Trie] = []
    for batch in batches:
        lang, source = langs.of(batch.column(0)), sources.of(batch.column(1))
        text = batch.column(2)
        text = text if text.type == pa.string() else text.cast(pa.string())
        n = len(text)
        bounds = np.frombuffer(text.buffers()[1], dtype=np.int32, count=n + 1, offset=4 * text.offset).astype(np.int64) if n else np.zeros(1, dtype=np.int64)
        raw = text.buffers()[2] if n else None
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
        low = 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + CHUNK, side="right")) - 1)
            held.append(text_trie(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], lang[low:high], source[low:high]))
            # like sizes meet, so a leaf is merged a few times only
            while len(held) > 1 and len(held[-2].start) < 2 * len(held[-1].start):
                held[-2:] = [merged(held[-2:])]
            if sum(len(t.start) for t in held) >= LEAVES:
                yield from _rows(merged(held), list(langs), list(sources))
                held = []
            low = high
    if held:
        yield from _rows(merged(held), list(langs), list(sources))


def _merge(least: int):
    """Adds up the equal neighbours of sorted leaves and keeps the terms of ``least`` documents and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the last term met, as one row: more of it may come
        for batch in batches:
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            if not n:
                continue
            langs, terms = batch.column(0), batch.column(1)
            new = np.ones(n, dtype=bool)
            if n > 1:
                new[1:] = pc.or_(pc.not_equal(langs[1:], langs[:-1]), pc.not_equal(terms[1:], terms[:-1])).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(new)
            ends = np.append(begin[1:], n)
            docs = np.add.reduceat(batch.column(2).to_numpy(), begin)
            keep = np.flatnonzero(docs[:-1] >= least)
            if len(keep):
                yield _added(batch, begin[keep], ends[keep], docs[keep])
            last = _added(batch, begin[-1:], ends[-1:], docs[-1:])
        if last is not None and last.column(2)[0].as_py() >= least:
            yield last

    return run


def _added(batch: pa.RecordBatch, begin: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """One row for the rows from each ``begin`` up to its end, counters added by source."""
    lists, numbers = _from_zero(batch.column(3)), _from_zero(batch.column(4))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    first, size = bounds[begin], bounds[ends] - bounds[begin]
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    coded = lists.values.take(pa.array(at)).dictionary_encode()
    code, owner = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(begin)), size)
    counts = numbers.values.to_numpy(zero_copy_only=False)[at]
    order = np.lexsort((code, owner))
    code, owner, counts = code[order], owner[order], counts[order]
    group = np.unique(_first(owner, code))
    offsets = pa.array(np.searchsorted(owner[group], np.arange(len(begin) + 1)).astype(np.int32))
    columns = [batch.column(c).take(pa.array(begin)) for c in (0, 1)]
    columns += [pa.array(docs), pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(code[group]))), pa.ListArray.from_arrays(offsets, pa.array(np.add.reduceat(counts, group)))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "term", "docs", "sources", "counts"])


def _from_zero(lists: pa.ListArray) -> pa.ListArray:
    """A list column whose offsets and values begin at its own first row."""
    offsets = lists.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), lists.values[int(offsets[0]) : int(offsets[-1])])


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, term, docs, sources, counts, range) of the terms that ``least`` documents of a language have, written
    in ranges of (lang, term); sources and counts only where a source has the term."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    # written, since a deal by range reads its rows twice
    counted = materialize(rows.mapInArrow(_count, _LEAF), "tries")
    ranged = counted.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge(least), _LEAF)
    return materialize(ranged.withColumn("range", F.spark_partition_id()), "terms")


def source_totals(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, kinds, sources, totals): of each language the number of kept terms, its sources in order and
    their occurrences of kept terms. One row a language: its sources are as many as the root of its pairs."""
    groups = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    counts = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    kinds = kept.groupBy("lang").agg(F.count("*").alias("kinds"))
    by_lang = groups.join(counts, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    return by_lang.join(kinds, "lang", "left").select("lang", F.coalesce("kinds", F.lit(0)).alias("kinds"), F.col("s.source").alias("sources"), F.col("s.n").alias("totals"))


def parts(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE count / whole), for count <= whole < 9 x 10^15, by long division in thousands."""
    value, rest = np.divmod(count, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        value = value * 1000 + more
    return value + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Language:
    """Totals of one language, sums by pair of sources and the best terms by source so far."""

    def __init__(self, name: str, kinds: int, sources: pa.Array, totals: np.ndarray):
        self.name, self.sources, self.whole, self.all = name, sources, totals + kinds, int(totals.sum()) + kinds
        s = self.size = len(sources)
        self.sums = np.zeros((s, s), dtype=np.int64) if s <= SQUARE else None
        #: By source (-value, term), the order of the report: strings compare as their UTF-8 bytes do.
        self.best: list[list[tuple[int, str]]] = [[]] * s

    def add(self, terms: pa.Array, sources: pa.ListArray, counts: pa.ListArray, top: int) -> Iterator[pa.RecordBatch]:
        """Terms in the order of their bytes; pair sums come out at once only where they are too many to hold."""
        step = max(1, CELLS // self.size)
        for low in range(0, len(terms), step):
            high = min(len(terms), low + step)
            bounds = sources.offsets.to_numpy()[low : high + 1]
            part = slice(int(bounds[0]), int(bounds[-1]))
            count = np.zeros((high - low, self.size), dtype=np.int64)
            at = pc.index_in(sources.values[part], value_set=self.sources).to_numpy(zero_copy_only=False)
            count[np.repeat(np.arange(high - low), np.diff(bounds)), at] = counts.values[part].to_numpy(zero_copy_only=False)
            p = parts(count + 1, self.whole)
            q = parts(count.sum(axis=1) + 1, self.all)
            for s in range(self.size):
                sums = divergence(p[:, [s]], p).sum(axis=0)
                if self.sums is None:
                    yield self._pairs(s, sums)
                else:
                    self.sums[s] += sums
                found = np.flatnonzero((count[:, s] > 0) & (p[:, s] > q))
                value = divergence(p[found, s], q[found])
                if len(found) > top:
                    best = np.sort(np.argsort(-value, kind="stable")[:top])
                    found, value = found[best], value[best]
                new = zip((-value).tolist(), terms.take(pa.array(found + low)).to_pylist(), strict=True)
                self.best[s] = sorted([*self.best[s], *new])[:top]

    def _pairs(self, s: int, sums: np.ndarray) -> pa.RecordBatch:
        keep = np.arange(self.size) != s
        return self._batch(s, "pair", self.sources.filter(pa.array(keep)), pa.array(sums[keep]))

    def _batch(self, s: int, part: str, items: pa.Array, values: pa.Array) -> pa.RecordBatch:
        n = len(items)
        same = [pa.array([v] * n, pa.string()) for v in (self.name, self.sources[s].as_py(), part)]
        return pa.RecordBatch.from_arrays([*same, items, values], ["lang", "source", "part", "item", "value"])

    def close(self) -> Iterator[pa.RecordBatch]:
        for s in range(self.size):
            if self.sums is not None and self.size > 1:
                yield self._pairs(s, self.sums[s])
            if self.best[s]:
                yield self._batch(s, "term", pa.array([t for _, t in self.best[s]], pa.string()), pa.array([-v for v, _ in self.best[s]], pa.int64()))


def _traverse(top: int):
    """Of sorted (lang, head, term, kinds, sources, counts), where a language's head row holds its totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Language | None = None
        for batch in batches:
            head = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            edges = np.append(np.flatnonzero(head), batch.num_rows)
            low = 0
            for edge in edges.tolist():
                if edge > low:
                    rows = batch.slice(low, edge - low)
                    lists = [_from_zero(rows.column(c)) for c in (4, 5)]
                    yield from now.add(rows.column(2), *lists, top)
                if edge < batch.num_rows and (now is None or now.name != batch.column(0)[edge].as_py()):
                    if now is not None:
                        yield from now.close()
                    sources, totals = (batch.column(c)[edge].values for c in (4, 5))
                    now = _Language(batch.column(0)[edge].as_py(), batch.column(3)[edge].as_py(), sources, totals.to_numpy(zero_copy_only=False))
                low = edge + 1
        if now is not None:
            yield from now.close()

    return run


def _ranked(rows: DataFrame, keys: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))


def divergence_audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: how a source's terms diverge from each other
    source of its language, over all kept terms. Part ``term``: the ``top`` terms that it has more of than its language."""
    kept = kept_terms(docs, least, text, lang, source)
    totals = materialize(source_totals(docs, kept, lang, source), "totals")
    heads = totals.join(kept.select("lang", "range").distinct(), "lang").select("lang", "range", F.lit(True).alias("head"), F.lit("").alias("term"), "kinds", "sources", F.col("totals").alias("counts"))
    lines = kept.select("lang", "range", F.lit(False).alias("head"), "term", F.lit(0).cast("long").alias("kinds"), "sources", "counts")
    dealt = heads.unionByName(lines).repartitionByRange("range").sortWithinPartitions("range", "lang", F.desc("head"), "term")
    # a task emits pairs and candidates however few terms it has, so tasks are as many as the terms ask for
    dealt = dealt.coalesce(max(1, -(-kept.count() // TERMS)))
    traversed = dealt.select("lang", "head", "term", "kinds", "sources", "counts").mapInArrow(_traverse(top), "lang string, source string, part string, item string, value long")
    found = materialize(traversed.withColumn("deal", F.spark_partition_id() % PARTS), "found")
    names = totals.select("lang", F.explode("sources").alias("source"))
    others = names.join(names.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").select("lang", "source", "item", "value").union(others).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", _ranked(pairs, ["lang", "source"]))
    # candidates are ranked by parts first, so that no task ranks those of all ranges
    terms = found.where("part = 'term'").withColumn("rank", _ranked(found, ["lang", "source", "deal"])).where(F.col("rank") <= top)
    terms = terms.withColumn("rank", _ranked(terms, ["lang", "source"])).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).union(terms.select(columns))
