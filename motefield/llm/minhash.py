"""MinHash near-dedup: DartMinHash signatures of word shingles, joined by bands, verified.

A document is its set of shingles (``WORDS`` consecutive words; a document of fewer words is
one shingle), each with a weight: 1, or how often it occurs. DartMinHash throws darts at the
plane of weight and rank: the cells of a fixed dyadic grid hold a Poisson number of darts
given by a hash of element and cell, and a dart's place, rank and coordinate are hashes too.
An element keeps the darts that fall within its weight; of a document's darts of rank below a
bound, which falls with its total weight so that about K ln K + 2K remain, each coordinate
keeps the earliest. A coordinate left empty doubles the bound. Two documents keep the same
dart at a coordinate with the probability of their weighted Jaccard similarity.

``BANDS`` bands of ``ROWS`` coordinates are hashed and equi-joined:
 1. Exact copies of a text are one representative with members.
 2. In a band that several representatives share, each signature is compared with that of the
    band's least document, its leader. Where some are not tied to it, the band is split into
    blocks and signatures are compared there, but for those that are tied already. A tie is an
    estimate near the threshold (within five standard errors) or above.
 3. The components of those ties are clusters. Their documents are compared exactly, by all
    shingles, with the cluster's leader; where some differ, in pairs of blocks, as in 2.
Only a star of each leader and spanning forests of blocks leave a group. Near copies of one text
are thus compared in linear work, and blocks meet only where a group is not all alike.
No group emits its pairs or meets in one task, and a pair that shares a band is compared
exactly unless links found before connect it anyway or its estimate refutes it. A pair of
similarity 0.8 shares no band with probability 3e-5.

Shingles are needed of documents in shared bands alone. Which those are is sent to the tasks
that read the texts as a bitmap of fixed size over hashed ids; what it lets through by chance
is dropped in the join with the clusters.

Null text counts as empty. Documents without words are near-duplicates of equal texts alone.
Rows that share an id are taken as one node: a link of any of them holds for the id. A row of
null id is a class of its own whatever its text: its class_id is null and it is kept. Texts
are read whole; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.words import GOLDEN, Words, chunks, mix, seeded, text_column
from motefield.operators.components import connected_components
from motefield.storage import forget, materialize, small_batches

WORDS, ROWS, BANDS = 5, 4, 20
COORDINATES = ROWS * BANDS
#: Darts below this rank lie in one cell; each further cell doubles the rank.
BASE_RANK = 2.0**-6
#: Documents of a block where signatures and where all shingles are compared.
BLOCK, EXACT_BLOCK = 1024, 256
#: Bytes of the bitmap of documents whose shingles are needed.
MAP_BYTES = 1 << 20
UNIT = 2.0**-53


def shingles(words: Words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times) of some texts, each shingle of a text once, in order."""
    n, doc, h = len(words.start), words.doc, words.hashes()
    counts = np.bincount(doc, minlength=words.rows.stop - words.rows.start)
    total, good = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
    if n >= size:
        m = n - size + 1
        for j in range(size):
            total[:m] = total[:m] * GOLDEN + h[j : m + j]
        good[:m] = doc[size - 1 :] == doc[:m]
    text, value = doc[good], mix(total[good])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        sums = np.zeros(len(short), dtype=np.uint64)
        for j in range(size - 1):
            more = counts[short] > j
            sums[more] = sums[more] * GOLDEN + h[words.first[short[more]] + j]
        text, value = np.concatenate((text, short)), np.concatenate((value, mix(sums + counts[short].astype(np.uint64))))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text)))


def poisson_steps(area: float) -> np.ndarray:
    """P(count <= i) for i from 0 until nothing is left to 64 bits."""
    out, term, total, i = [], math.exp(-area), 0.0, 0
    while total < 1 - 2.0**-52 and i < 20 * area + 60:
        total += term
        out.append(total)
        i += 1
        term *= area / i
    return np.array(out)


def uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * UNIT


def darts(value: np.ndarray, weight: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, rank, dart) of darts within the weight and below the rank bound of elements."""
    found = [], [], []
    cells_w = [(0.0, 1.0)]
    while len(weight) and cells_w[-1][1] < weight.max():
        cells_w.append((cells_w[-1][1], 2 * cells_w[-1][1]))
    for w, (w_low, w_high) in enumerate(cells_w):
        r_low, r_high, r = 0.0, BASE_RANK, 0
        deep = weight > w_low
        while True:
            use = np.flatnonzero(deep & (bound > r_low))
            if not len(use):
                break
            h = mix(value[use] ^ seeded(1000 * w + r))
            count = np.searchsorted(poisson_steps((w_high - w_low) * (r_high - r_low)), uniform(h), side="right")
            some = np.flatnonzero(count)
            count = count[some]
            at = np.repeat(some, count)
            turn = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(h[at] + (turn.astype(np.uint64) + np.uint64(1)) * GOLDEN)
            rank = r_low + uniform(mix(dart + np.uint64(1))) * (r_high - r_low)
            place = w_low + uniform(mix(dart + np.uint64(2))) * (w_high - w_low)
            own = use[at]
            hit = (place < weight[own]) & (rank < bound[own])
            for into, what in zip(found, (own[hit], rank[hit], dart[hit]), strict=True):
                into.append(what)
            r_low, r_high, r = r_high, 2 * r_high, r + 1
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in zip(found, (np.int64, np.float64, np.uint64), strict=True))


def signatures(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart at each coordinate, shape (n, k); texts without elements get zeros."""
    out = np.zeros((n, k), dtype=np.uint64)
    total = np.bincount(text, weights=weight, minlength=n)
    bound = np.divide(k * (math.log(k) + 2), total, out=np.zeros(n), where=total > 0)
    todo = total > 0
    while todo.any():
        use = np.flatnonzero(todo[text])
        element, rank, dart = darts(value[use], weight[use], bound[text[use]])
        own = text[use][element]
        key = own * k + (mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        flat = out.reshape(-1)
        flat[key[order]] = dart[order] | np.uint64(1)
        todo &= (out == 0).any(axis=1)
        bound[todo] *= 2
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    n = len(signature)
    part = signature.reshape(n, BANDS, ROWS)
    h = np.tile(np.array([seeded(500 + b) for b in range(BANDS)], dtype=np.uint64), (n, 1))
    for r in range(ROWS):
        h = mix(h * GOLDEN + part[:, :, r])
    return h


def signed(docs: DataFrame, weights: str) -> DataFrame:
    """(doc, t1, t2, n, bands, sig): number of shingles, band hashes, 8 bits of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(text_column(batch, 1)):
                n = words.rows.stop - words.rows.start
                text, value, times = shingles(words)
                sig = signatures(text, value, times.astype(float) if weights == "count" else np.ones(len(text)), n)
                size = np.bincount(text, minlength=n)
                bands = [b if s else None for b, s in zip(band_hashes(sig).view(np.int64), size, strict=True)]
                low = sig.astype(np.uint8)
                columns = [batch.column(0).slice(words.rows.start, n), *batch_columns(batch, words.rows, n), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array([x.tobytes() for x in low], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "t1", "t2", "n", "bands", "sig"])

    rows = docs.select("doc", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(5), "text").alias("t2"))
    return rows.mapInArrow(run, "doc long, t1 long, t2 long, n long, bands array<long>, sig binary")


def batch_columns(batch: pa.RecordBatch, rows: slice, n: int) -> list[pa.Array]:
    return [batch.column(c).slice(rows.start, n) for c in (2, 3)]


def bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of hashed ids: ``MAP_BYTES`` bytes whatever their number, gathered as parts of 4 KB."""
    place = F.pmod(F.xxhash64("doc"), F.lit(8 * MAP_BYTES)) + 1
    parts = ids.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((MAP_BYTES // 4096, 4096), dtype=np.uint8)
    for r in parts.collect():
        out[r.part - 1] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.ravel()


def shingle_sets(docs: DataFrame, weights: str, wanted: np.ndarray) -> DataFrame:
    """(doc, values, times): the sorted shingles of the documents that the bitmap names."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)  # MAP_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            place = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))
            for words in chunks(text_column(batch, 1)):
                n = words.rows.stop - words.rows.start
                text, value, times = shingles(words)
                cut = np.searchsorted(text, np.arange(n + 1))
                parts = list(zip(cut, cut[1:], strict=False))
                held_times = [times[a:b].astype("<u4").tobytes() for a, b in parts] if weights == "count" else [None] * n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.rows.start, n), pa.array([value[a:b].tobytes() for a, b in parts], pa.binary()), pa.array(held_times, pa.binary())], ["doc", "values", "times"])

    place = F.pmod(F.xxhash64("doc"), F.lit(8 * MAP_BYTES)).alias("place")
    return docs.select("doc", "text", place).mapInArrow(run, "doc long, values binary, times binary")


def similarity(a: bytes, b: bytes, x: bytes | None, y: bytes | None) -> float:
    """Weighted Jaccard similarity of two sorted sets of shingles."""
    p, q = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if not len(p) or not len(q):
        return 0.0
    spot = np.minimum(np.searchsorted(q, p), len(q) - 1)
    same = q[spot] == p
    if x is None:
        shared = int(same.sum())
        return shared / (len(p) + len(q) - shared)
    v, w = np.frombuffer(x, dtype="<u4").astype(float), np.frombuffer(y, dtype="<u4").astype(float)
    shared = float(np.minimum(v[same], w[spot[same]]).sum())
    return shared / (v.sum() + w.sum() - shared)


def in_blocks(rows: DataFrame, group: str, block: int, parts: int) -> DataFrame:
    """Rows of each group dealt into blocks, once for each pair (low, high) of blocks.

    ``star`` marks rows that are tied already; they get blocks of their own, behind those of
    the ``outer`` other rows, and no two of their blocks meet.
    """
    own = F.pmod(F.xxhash64("doc"), F.when(F.col("star"), F.col("stars")).otherwise(F.col("others"))).cast("int")
    return (
        rows.withColumns({"stars": F.ceil(F.col("inner") / block).cast("int"), "others": F.ceil(F.col("outer") / block).cast("int")})
        .withColumn("block", own + F.when(F.col("star"), F.col("others")).otherwise(0))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") + F.when(F.col("star"), 0).otherwise(F.col("stars")) - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .drop("stars", "others", "other", "inner", "outer")
        .repartition(parts, group, "low", "high")
    )


def open_groups(stars: DataFrame, group: str) -> DataFrame:
    """Rows of the groups in which something is not tied to the leader, with both counts."""
    counts = stars.groupBy(group).agg(F.count_if("star").alias("inner"), F.count_if(~F.col("star")).alias("outer")).where("outer > 0")
    return stars.select(group, "doc", "star").join(materialize(counts, "counts"), group)


def near_leaders(met: DataFrame, threshold: float, least: float, sizes: bool) -> DataFrame:
    """(band, doc, lead, star): whether the estimate ties a document to the leader of its band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, doc, lead, n, lead_n = (batch.column(c).to_numpy() for c in range(5))
            sig, of_lead = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(len(doc), -1) for c in (5, 6))
            star = (sig == of_lead).mean(axis=1) >= least if len(doc) else np.zeros(0, dtype=bool)
            if sizes:
                star &= np.minimum(n, lead_n) >= threshold * np.maximum(n, lead_n)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (band, doc, lead, star | (doc == lead))], ["band", "doc", "lead", "star"])

    return met.select("band", "doc", "lead", "n", "lead_n", "sig", "lead_sig").mapInArrow(run, "band long, doc long, lead long, star boolean")


def like_leaders(whole: DataFrame, threshold: float, block: int, parts: int) -> DataFrame:
    """(cluster, doc, star, link): exact comparison of each document with its cluster's leader.

    A cluster's documents are dealt into slots of about ``block``, and its leader to each of
    these. ``link``: a row of the document is similar enough; ``star``: all its rows are.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cluster = int(rows["cluster"].iloc[0])
        doc, values, times = rows["doc"].to_numpy(), rows["values"].to_numpy(), rows["times"].to_numpy()
        first = np.flatnonzero(doc == cluster)
        like = [d == cluster or any(similarity(values[f], values[i], times[f], times[i]) >= threshold for f in first) for i, d in enumerate(doc)]
        return pd.DataFrame({"cluster": cluster, "doc": doc, "like": np.array(like, dtype=bool)})

    slots = F.ceil(F.col("size") / block).cast("int")
    dealt = whole.withColumn("slot", F.explode(F.when(F.col("doc") == F.col("cluster"), F.sequence(F.lit(0), slots - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), slots).cast("int")))))
    found = dealt.select("cluster", "slot", "doc", "values", "times").repartition(parts, "cluster", "slot").groupBy("cluster", "slot").applyInPandas(run, "cluster long, doc long, like boolean")
    return found.groupBy("cluster", "doc").agg(F.bool_and("like").alias("star"), F.bool_or("like").alias("link"))


def forest(threshold: float, least: float, sizes: bool, exact: bool):
    """Ties of one pair of blocks: each document and the least one that it is tied to, by
    estimates, or by exact comparisons where the shingles are there (``exact``). Rows marked
    ``star`` are one tree from the start."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc", kind="stable")
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        doc, block, n, star = (rows[c].to_numpy() for c in ("doc", "block", "n", "star"))
        sig = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint8).reshape(len(rows), -1)
        values, times = (rows["values"].to_numpy(), rows["times"].to_numpy()) if exact else (None, None)
        root = np.arange(len(rows))
        if star.any():
            root[star.astype(bool)] = np.flatnonzero(star)[0]
        began = np.unique(root)
        a = np.flatnonzero(block == low)
        b = a if low == high else np.flatnonzero(block == high)
        for i in a:
            other = b[(root[b] != root[i]) & (b > i)] if low == high else b[root[b] != root[i]]
            if sizes:  # sets of too different sizes are not similar enough
                other = other[np.minimum(n[other], n[i]) >= threshold * np.maximum(n[other], n[i])]
            if not len(other):
                continue
            same = (sig[other] == sig[i]).mean(axis=1)
            near = np.flatnonzero(same >= least)
            if exact:
                for j in other[near[np.argsort(-same[near], kind="stable")]]:
                    if root[j] != root[i] and similarity(values[i], values[j], times[i], times[j]) >= threshold:
                        p, q = sorted((root[i], root[j]))
                        root[root == q] = p
            elif len(near):
                joined = np.unique(np.append(root[other[near]], root[i]))
                root[np.isin(root, joined)] = joined[0]
        tied = began[root[began] != began]
        return pd.DataFrame({"src": doc[root[tied]], "dst": doc[tied]})

    return run


def near_duplicate_classes(rows: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, weights: str = "set") -> DataFrame:
    """``key``, ``class_id`` (the least id of its class) and ``kept`` (it is that one, or null)."""
    small_batches(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / COORDINATES)
    edge, by_size = "src long, dst long", weights == "set"
    docs = rows.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table = materialize(signed(docs, weights), "signed")
    # aggregates are written before they are joined: a join of written tables splits the rows of a hot key
    copies = materialize(table.groupBy("t1", "t2").agg(F.min("doc").alias("rep")), "copies")
    members = materialize(table.select("doc", "t1", "t2").distinct().join(copies, ["t1", "t2"]).select("doc", "rep"), "members")
    reps = table.join(members.where("doc = rep").select("doc").distinct(), "doc", "left_semi").where("n > 0")
    marks = reps.select("doc", "n", "sig").dropDuplicates(["doc"])
    banded = materialize(reps.select("doc", F.explode("bands").alias("band")), "bands")
    busy = banded.groupBy("band").agg(F.min("doc").alias("lead"), F.max("doc").alias("most")).where("lead <> most").select("band", "lead")
    led = busy.join(marks.select(F.col("doc").alias("lead"), F.col("n").alias("lead_n"), F.col("sig").alias("lead_sig")), "lead")
    stars = materialize(near_leaders(banded.distinct().join(led, "band").join(marks, "doc"), threshold, least, by_size), "stars")
    forget(banded)
    met = in_blocks(open_groups(stars, "band").join(marks, "doc"), "band", BLOCK, parts)
    more = met.groupBy("band", "low", "high").applyInPandas(forest(threshold, least, by_size, False), edge)
    ties = materialize(stars.where("star and doc <> lead").select(F.col("lead").alias("src"), F.col("doc").alias("dst")).union(more).distinct(), "ties")
    clusters = connected_components(ties).withColumnsRenamed({"node": "doc", "component": "cluster"})
    sizes = materialize(clusters.groupBy("cluster").agg(F.count("*").alias("size")), "sizes")
    placed = materialize(clusters.join(sizes, "cluster"), "clusters")
    alike = materialize(like_leaders(placed.join(shingle_sets(docs, weights, bitmap(placed.select("doc"))), "doc"), threshold, EXACT_BLOCK, parts), "alike")
    rest = materialize(open_groups(alike, "cluster"), "open")
    whole = rest.join(marks, "doc").join(shingle_sets(docs, weights, bitmap(rest.select("doc"))), "doc")
    other = in_blocks(whole, "cluster", EXACT_BLOCK, parts).groupBy("cluster", "low", "high").applyInPandas(forest(threshold, least, by_size, True), edge)
    links = materialize(alike.where("link and doc <> cluster").select(F.col("cluster").alias("src"), F.col("doc").alias("dst")).union(other).distinct(), "links")
    own = members.select(F.col("doc").alias("src"), F.col("rep").alias("dst")).where("src <> dst")
    final = connected_components(links.union(own))
    return docs.select("doc").join(final, F.col("doc") == F.col("node"), "left").select(F.col("doc").alias(key), F.coalesce("component", "doc").alias("class_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("class_id")))
