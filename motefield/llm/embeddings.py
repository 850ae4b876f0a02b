"""Embedding near-dedup: cross-polytope hashing, multiprobe buckets, verified links.

A vector is scaled to length one and rotated by three rounds of random signs and a fast
Hadamard transform; a cross-polytope hash is the signed axis nearest to the result. A table
joins ``width`` such hashes into a bucket, and a vector also enters the buckets of its next
nearest axes (its probes). How many hashes a table joins follows from the number of vectors,
so that a bucket of unrelated vectors stays near ``BUCKET`` rows; how many tables there are
follows from the share of pairs at the threshold that one table finds, measured on random
pairs of that dimension, so that all tables miss at most ``MISS`` of them.

A bucket is compared in blocks of at most about ``BLOCK`` rows, each pair of blocks in a group
of its own, so no task holds a bucket. A group counts its links by matrix products and
returns one row for each vector with links: how many, and the least vector that its links
within the group reach. Pairs themselves are never emitted. A pair that meets in several
buckets counts in the first that it shares.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
nor do vectors of different lengths with each other. Rows of null id link with nothing either:
their component is null and they are kept. Equal vectors are compared once and
count as linked copies. A row repeated with id and vector counts once; an empty table gives
none; other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.operators.components import connected_components
from motefield.storage import materialize

BUCKET, BLOCK, PROBES, MISS, MOST_WIDTH = 4096, 1024, 3, 1e-4, 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` transformed by the orthonormal Hadamard matrix; 2^k columns."""
    n, half = x.shape[1], 1
    x = x.copy()
    while half < n:
        y = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        half *= 2
    return x / math.sqrt(n)


def padded_size(dim: int) -> int:
    return 1 << max(2, (dim - 1).bit_length())


def rotations(dim: int, count: int) -> np.ndarray:
    """Signs of ``count`` rotations, the same in every worker."""
    return np.random.default_rng((20_241, dim)).choice((-1.0, 1.0), size=(count, 3, padded_size(dim)))


def buckets(unit: np.ndarray, tables: int, width: int, probes: int = PROBES) -> np.ndarray:
    """Bucket ids, shape (vectors, tables, probes); a table's probes are all different."""
    n, dim = unit.shape
    size = padded_size(dim)
    x = np.zeros((n, size))
    x[:, :dim] = unit
    signs = rotations(dim, tables * width)
    out = np.empty((n, tables, probes), dtype=np.int64)
    choices = np.stack(np.meshgrid(*[np.arange(probes)] * width, indexing="ij"), axis=-1).reshape(-1, width)
    for t in range(tables):
        loss, axis = np.zeros((n, len(choices))), np.full((n, len(choices)), t + 1, dtype=np.uint64)
        for w in range(width):
            y = x
            for s in signs[t * width + w]:
                y = hadamard(y * s)
            best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
            value = np.take_along_axis(y, best, axis=1)
            code = (2 * best + (value < 0)).astype(np.uint64)
            loss += (np.abs(value[:, :1]) - np.abs(value))[:, choices[:, w]] ** 2
            axis = axis * np.uint64(2 * size + 1) + code[:, choices[:, w]]
        first = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(axis, first, axis=1) * np.uint64(4099) + np.uint64(dim)
        out[:, t] = (found & np.uint64((1 << 63) - 1)).astype(np.int64)
    return out


def plan(count: int, dim: int, threshold: float) -> tuple[int, int]:
    """(tables, width) for so many vectors of that dimension."""
    width = 1
    while width < MOST_WIDTH and count * PROBES / (2 * padded_size(dim)) ** width > BUCKET:
        width += 1
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((2, 4000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    c = threshold * a + math.sqrt(1 - threshold**2) * b
    p, q = buckets(a, 1, width)[:, 0], buckets(c, 1, width)[:, 0]
    found = min((p[:, :, None] == q[:, None, :]).any((1, 2)).mean(), 1 - 1e-6)
    return max(1, math.ceil(math.log(MISS) / math.log(1 - found))), width


def hashed(vectors: DataFrame, shapes: dict[int, tuple[int, int]]) -> DataFrame:
    """(rep, copies, dim, unit, places): unit vectors as doubles, and their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, (tables, width) in shapes.items():
                own = batch.filter(pa.compute.equal(batch.column(2), dim))
                if not own.num_rows:
                    continue
                raw = own.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                unit = raw / np.abs(raw).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                places = buckets(unit, tables, width).reshape(len(unit), -1)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(list(places), pa.list_(pa.int64()))], ["rep", "copies", "dim", "unit", "places"])

    return vectors.select("rep", "copies", "dim", "vector").mapInArrow(run, "rep long, copies long, dim int, unit binary, places array<long>")


def first_shared(p: np.ndarray, q: np.ndarray, probes: int) -> np.ndarray:
    """The least bucket that rows of ``p`` and ``q`` share; they share one."""
    least = np.full(len(p), np.iinfo(np.int64).max)
    for t in range(0, p.shape[1], probes):
        for i in range(t, t + probes):
            for j in range(t, t + probes):
                same = p[:, i] == q[:, j]
                least[same] = np.minimum(least[same], p[same, i])
    return least


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows, the least row that links (a, b) reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare_blocks(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable").reset_index(drop=True)
        bucket, low, high = int(rows["place"].iloc[0]), int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        x = np.frombuffer(b"".join(rows["unit"]), dtype=np.float64).reshape(len(rows), -1)
        places, block = np.stack(rows["places"].to_numpy()), rows["block"].to_numpy()
        at_a = np.flatnonzero(block == low)
        at_b = at_a if low == high else np.flatnonzero(block == high)
        cosine = x[at_a] @ x[at_b].T
        i, j = np.nonzero(cosine >= threshold)
        a, b = at_a[i], at_b[j]
        if low == high:
            a, b = a[a < b], b[a < b]
        links, copies = np.zeros(len(rows), dtype=np.int64), rows["copies"].to_numpy()
        for s in range(0, len(a), 1 << 18):
            p, q = a[s : s + (1 << 18)], b[s : s + (1 << 18)]
            here = first_shared(places[p], places[q], PROBES) == bucket
            np.add.at(links, p[here], copies[q[here]])
            np.add.at(links, q[here], copies[p[here]])
        root = local_roots(len(rows), a, b)
        told = np.zeros(len(rows), dtype=bool)
        told[a] = told[b] = True
        reps = rows["rep"].to_numpy()
        return pd.DataFrame({"rep": reps[told], "links": links[told], "hub": reps[root[told]]})

    return run


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every vector."""
    value = F.col(vector).cast("array<double>")
    good = F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.exists("v", lambda x: x != 0)
    given = rows.select(F.col(key).cast("long").alias("id"), value.alias("v"))
    sound = given.where(good & F.col("id").isNotNull()).select("id", F.col("v").alias("vector"), F.transform("v", lambda x: x + F.lit(0.0)).alias("w"))
    keyed = sound.select("id", "vector", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(3), "w").alias("h2"))
    keyed = materialize(keyed, "vectors")
    # aggregates are written before they are joined: a join of written tables splits the rows of a hot key
    groups = materialize(keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies")), "groups")
    reps = keyed.join(groups, ["h1", "h2"]).where("id = rep").select("rep", "copies", F.size("vector").alias("dim"), "vector").dropDuplicates(["rep", "vector"])
    # one row for each dimension that occurs
    shapes = {r.dim: plan(r["n"], r.dim, threshold) for r in keyed.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}
    table = materialize(hashed(reps, shapes), "hashed")
    placed = table.select("rep", "copies", "unit", "places", F.explode("places").alias("place"))
    sizes = placed.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").select("place", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocks = (
        placed.join(materialize(sizes, "sizes"), "place")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("place", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "copies", "unit", "places")
    )
    found = materialize(blocks.groupBy("place", "low", "high").applyInPandas(compare_blocks(threshold), "rep long, links long, hub long"), "links")
    links = materialize(found.groupBy("rep").agg(F.sum("links").alias("links")), "counts")
    parts = connected_components(found.where("rep <> hub").select(F.col("rep").alias("src"), F.col("hub").alias("dst")))
    members = keyed.select("id", "h1", "h2").distinct().join(groups, ["h1", "h2"])
    linked = (
        members.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    alone = given.where(~F.coalesce(good, F.lit(False)) | F.col("id").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
