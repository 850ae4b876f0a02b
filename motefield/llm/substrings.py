"""Substring dedup by recompression: words that a long passage of an earlier document repeats.

A window is ``window`` consecutive words of one document; a word goes if a window covers it
whose word sequence also starts in a document with a smaller id.

Recompression shortens every text by naming. First each longest run of a word is named by
word and length; then each round splits the symbols into left and right ones by a hash of
their names and names every left-right pair of neighbours. Names are hashes of what they
stand for, so all tasks give the same name to the same thing and a round needs no dictionary
to be gathered or sent around. Whether and how a symbol arises depends on the words of a
known stretch around it alone, its context. Equal windows therefore hold equal symbols
wherever a context lies inside them. After ``ROUNDS`` rounds a symbol stands for about eight
words, and Spark joins the symbols with their least and largest document: a window can repeat
only if every symbol whose context it holds is shared. Those windows - a small part - are
verified by a 128-bit hash of all their words, again by an aggregate and an equi-join. The
filter is a necessary condition, so no repeat is lost, whatever a text looks like.

Exact copies of a text are found first, by a 128-bit hash of the text; all but the least
document lose all words, if they have a window at all, and send no windows.

Null text has no words. Rows that share an id count as one document when sources are sought
and are judged each on its own text: starts of windows carry a tag of the text that they are
in. Rows of null id are no source and keep all words. Texts are processed whole; an empty table gives no rows;
other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.llm.words import GOLDEN, Words, chunks, mix, seeded, text_column
from motefield.storage import materialize

WINDOW, ROUNDS = 50, 7
#: Rows of exploded symbols or windows in one Arrow batch.
BATCH = 200_000
#: Fixed value: a word in UTF-8.
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def symbols(words: Words, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, text, low, high) of the symbols of some texts: the context is the words from
    low up to high. A context that touches an end of its text is left open: low is -1 or high
    past the last word, so that no window holds it.
    """
    n = len(words.start)
    name, doc = words.hashes(), words.doc.astype(np.int32)
    far = np.int32(n + 1)
    low, high = np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
    if not n:
        return name, doc, low, high
    # runs of one word; that a run ends is seen from its neighbours, so they are context
    new = np.ones(n, dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    run = length > 1
    name, doc = name[first], doc[first]
    name[run] = mix(name[run] ^ mix(length[run].astype(np.uint64) + seeded(0)))
    k = len(first)
    low, high = np.full(k, -1, dtype=np.int32), np.full(k, far, dtype=np.int32)
    near = doc[1:] == doc[:-1]
    low[1:] = np.where(near, first[1:] - 1, -1)
    high[:-1] = np.where(near, first[1:] + 1, far)
    for r in range(rounds):
        k = len(name)
        left = (mix(name ^ seeded(2 * r + 1)) >> np.uint64(63)).astype(bool)
        near = doc[1:] == doc[:-1]
        pair = np.zeros(k, dtype=bool)
        pair[:-1] = left[:-1] & ~left[1:] & near
        second = np.zeros(k, dtype=bool)
        second[1:] = pair[:-1]
        # a left symbol's fate hangs on its right neighbour, a right symbol's on its left one
        after_low, after_high = np.full(k, -1, dtype=np.int32), np.full(k, far, dtype=np.int32)
        after_low[:-1], after_high[:-1] = np.where(near, low[1:], -1), np.where(near, high[1:], far)
        before_low, before_high = np.full(k, -1, dtype=np.int32), np.full(k, far, dtype=np.int32)
        before_low[1:], before_high[1:] = np.where(near, low[:-1], -1), np.where(near, high[:-1], far)
        low, high = np.minimum(low, np.where(left, after_low, before_low)), np.maximum(high, np.where(left, after_high, before_high))
        at = np.flatnonzero(pair)
        name[at] = mix(name[at] * GOLDEN + mix(name[at + 1] + seeded(2 * r + 2)))
        keep = ~second
        name, doc, low, high = name[keep], doc[keep], low[keep], high[keep]
    return name, doc, low, high


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(valid, h1, h2): for each word, whether a window starts there, and its hash."""
    n = len(words.start)
    valid = np.zeros(n, dtype=bool)
    if n >= size:
        valid[: n - size + 1] = words.doc[size - 1 :] == words.doc[: n - size + 1]
    out = []
    for which, base in enumerate((0x9E3779B97F4A7C15, 0xD1342543DE82EF95)):
        h, total, done, weight = words.hashes(which), np.zeros(n, dtype=np.uint64), 0, np.uint64(1)
        # doubling: the hash of 2m words from two hashes of m words
        parts, m, power = h, 1, np.uint64(base)
        bits = size
        with np.errstate(over="ignore"):
            while bits:
                if bits & 1 and n > done:
                    total[: n - done] += parts[done:] * weight
                    weight = weight * power
                    done += m
                bits >>= 1
                if bits:
                    shifted = np.zeros(n, dtype=np.uint64)
                    shifted[: max(0, n - m)] = parts[m:]
                    parts = parts + shifted * power
                    power, m = power * power, 2 * m
        out.append(mix(total))
    return valid, out[0], out[1]


def candidates(words: Words, shared: np.ndarray, low: np.ndarray, high: np.ndarray, valid: np.ndarray, size: int) -> np.ndarray:
    """Windows that hold no context of a symbol that is not ``shared``."""
    n = len(words.start)
    bad = ~shared & (low >= 0) & (high <= n)
    begin, stop = np.maximum(high[bad] - size, 0), low[bad] + 1
    some = stop > begin
    hits = np.zeros(n + 1, dtype=np.int32)
    np.add.at(hits, begin[some], 1)
    np.add.at(hits, stop[some], -1)
    return valid & (np.cumsum(hits[:n]) == 0)


def symbol_rows(docs: DataFrame, size: int) -> DataFrame:
    """(name, doc) of every symbol that some window of ``size`` words can hold, once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for words in chunks(text_column(batch, 1)):
                name, doc, low, high = symbols(words)
                held = (low >= 0) & (high <= len(words.start)) & (high - low <= size)
                name, doc = name[held], doc[held]
                order = np.lexsort((name, doc))
                name, doc = name[order], doc[order]
                new = np.ones(len(name), dtype=bool)
                new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
                name, own = name[new].view(np.int64), ids[words.rows][doc[new]]
                for s in range(0, len(name), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(name[s : s + BATCH]), pa.array(own[s : s + BATCH], pa.int64())], ["name", "doc"])

    return docs.select("doc", "text").mapInArrow(run, "name long, doc long")


def shared_names(docs: DataFrame, size: int) -> DataFrame:
    """(doc, names, early): the shared symbols of each document, and for each whether a
    smaller document has it."""
    rows = symbol_rows(docs, size)
    # written, so that the join can split the rows of a very common symbol
    ends = rows.groupBy("name").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least <> most").select("name", "least")
    return rows.join(materialize(ends, "names"), "name").groupBy("doc").agg(F.collect_list(F.struct("name", (F.col("least") < F.col("doc")).alias("early"))).alias("shared")).select("doc", F.col("shared.name").alias("names"), F.col("shared.early").alias("early"))


#: Starts are kept as places with a tag of the text in the bits above these.
PLACE = (1 << 32) - 1


def text_tag(text: Column) -> Column:
    return F.xxhash64(F.lit(9), text).bitwiseAND(F.lit((1 << 31) - 1))


def window_rows(marked: DataFrame, size: int, early: bool) -> DataFrame:
    """(h1, h2, doc) of windows that may repeat, once a document; with ``early`` only those whose
    symbols all lie in some smaller document, and with their tagged places in the text, so that
    a window that fills a text by repeating is one row still."""
    names = ["h1", "h2", "doc", "pos"] if early else ["h1", "h2", "doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(4).to_numpy()
            lists, flags = batch.column(2), batch.column(3)
            offsets = lists.offsets.to_numpy()
            known = lists.values.to_numpy(zero_copy_only=False)
            soon = flags.values.to_numpy(zero_copy_only=False).astype(bool)
            for words in chunks(text_column(batch, 1)):
                n = len(words.start)
                if not n:
                    continue
                name, doc, low, high = symbols(words)
                valid, h1, h2 = window_hashes(words, size)
                # names of the document's own list, found by sorting (document, name)
                a, b = words.rows.start, words.rows.stop
                own, mine = known[offsets[a] : offsets[b]], np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
                if early:
                    use = soon[offsets[a] : offsets[b]]
                    own, mine = own[use], mine[use]
                salt = seeded(99)
                key = np.unique(mix(own.view(np.uint64) ^ mix(mine.astype(np.uint64) + salt)))
                sought = mix(name ^ mix(doc.astype(np.uint64) + salt))
                shared = np.zeros(len(name), dtype=bool)
                if len(key):
                    spot = np.minimum(np.searchsorted(key, sought), len(key) - 1)
                    shared = key[spot] == sought
                at = np.flatnonzero(candidates(words, shared, low, high, valid, size))
                if not len(at):
                    continue
                at = at[np.lexsort((h2[at], h1[at], words.doc[at]))]
                text = words.doc[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (h1[at][1:] != h1[at][:-1]) | (h2[at][1:] != h2[at][:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                own_id, ends = ids[words.rows][text[first]], np.append(first, len(at))
                place = (tags[words.rows][text] << 32) | (at - words.first[text])
                for s in range(0, len(first), BATCH):
                    cut = first[s : s + BATCH]
                    columns = [pa.array(c, pa.int64()) for c in (h1[at[cut]].view(np.int64), h2[at[cut]].view(np.int64), own_id[s : s + BATCH])]
                    if early:
                        bounds = ends[s : s + len(cut) + 1]
                        columns.append(pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(place[bounds[0] : bounds[-1]], pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = "h1 long, h2 long, doc long" + (", pos array<long>" if early else "")
    return marked.select("doc", "text", "names", "early", "tag").mapInArrow(run, schema)


def copies_of(docs: DataFrame) -> DataFrame:
    """(doc, first) of documents all of whose texts smaller documents have."""
    keyed = docs.select("doc", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(5), "text").alias("t2"))
    least = keyed.groupBy("t1", "t2").agg(F.min("doc").alias("first"))
    return keyed.join(materialize(least, "texts"), ["t1", "t2"]).groupBy("doc").agg(F.min("first").alias("first"), F.max("first").alias("last")).where("last < doc").select("doc", "first")


def removed_starts(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc, first, starts): first: a smaller document with the same text, if there is one,
    and then all windows go; else the tagged starts of the windows that go."""
    docs = docs.where("doc is not null").withColumn("tag", text_tag(F.col("text")))
    shared = materialize(shared_names(docs, size), "shared")
    copies = materialize(copies_of(docs), "copies")
    nothing = F.array().cast("array<long>"), F.array().cast("array<boolean>")
    marked = (
        docs.join(shared, "doc", "left").join(copies, "doc", "left_anti")
        .select("doc", "text", F.coalesce("names", nothing[0]).alias("names"), F.coalesce("early", nothing[1]).alias("early"), "tag")
    )
    least = window_rows(marked, size, False).groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least <> most").select("h1", "h2", "least")
    # written, so that the join can split the rows of a window that very many documents have
    gone = window_rows(marked, size, True).join(materialize(least, "windows"), ["h1", "h2"]).where("least < doc")
    starts = gone.groupBy("doc").agg(F.flatten(F.collect_list("pos")).alias("starts"))
    return starts.join(copies, "doc", "full")


def _covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    steps = np.zeros(n + 1, dtype=np.int64)
    starts = starts[starts <= n - size]
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + size, -1)
    return np.cumsum(steps[:n]) > 0


def dedup_substrings(rows: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``key``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by a
    space) of every row."""
    docs = rows.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    gone = removed_starts(docs, size)
    names = [key, "n_words", "n_removed", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests = [], [], []
            for value, tag, first, starts in zip(*(batch.column(c) for c in (1, 2, 3, 4)), strict=True):
                words = value.as_py().encode().split()  # bytes split at exactly the bytes 9-13 and 32
                over = _gone(len(words), tag, first, starts, size)
                counts.append(len(words))
                removed.append(int(over.sum()) if over is not None else 0)
                digests.append(hashlib.sha256(b" ".join(words if over is None else [w for w, g in zip(words, over, strict=True) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names)

    return docs.join(gone, "doc", "left").select("doc", "text", text_tag(F.col("text")), "first", "starts").mapInArrow(run, f"`{key}` long, n_words long, n_removed long, kept_sha256 string")


def _gone(n: int, tag: pa.Scalar, first: pa.Scalar, starts: pa.Scalar, size: int) -> np.ndarray | None:
    """Which of a text's words go; None: none of them."""
    if first.is_valid:
        return np.ones(n, dtype=bool) if n >= size else None
    if not starts.is_valid:
        return None
    at = starts.values.to_numpy()
    return _covered(n, at[at >> 32 == tag.as_py()] & PLACE, size)


def cut_documents(rows: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows, all columns, with the words that go cut out of ``text``.

    A text that loses nothing stays as it is; else its kept stretches stay as they are, white
    space inside them included, and are joined by a space.
    """
    docs = rows.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    gone = removed_starts(docs, size).toDF("_doc", "_starts", "_first")
    at, names = rows.columns.index(text), rows.columns
    plain = [f"_c{i}" for i in range(len(names))]  # no column of the input can clash with those joined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, (tag, first, starts) = batch.column(at), (batch.column(batch.num_columns - k) for k in (3, 2, 1))
            changed = column.to_pylist()
            for i in range(batch.num_rows):
                if changed[i] is None or not (first[i].is_valid or starts[i].is_valid):
                    continue
                raw = changed[i].encode()
                spans = [m.span() for m in WORD.finditer(raw)]
                over = _gone(len(spans), tag[i], first[i], starts[i], size)
                if over is None or not over.any():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([True], over, [True])).astype(np.int8)))
                changed[i] = b" ".join(raw[spans[a][0] : spans[b - 1][1]] for a, b in edge.reshape(-1, 2)).decode()
            yield pa.RecordBatch.from_arrays([pa.array(changed, pa.string()) if c == at else batch.column(c) for c in range(batch.num_columns - 3)], names=names)

    own = F.col(plain[names.index(key)]).cast("long")
    joined = rows.toDF(*plain).join(gone, own == F.col("_doc"), "left")
    return joined.select(*plain, text_tag(F.coalesce(plain[at], F.lit(""))), "_first", "_starts").mapInArrow(run, rows.schema)
