"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces a node's neighbours by the smallest of them, so the table shrinks to
stars in a number of rounds that grows with the logarithm of the longest path. Every step is
a partial aggregate and an equi-join; no node's neighbours are gathered anywhere. The least
neighbours are written before they are joined, so the join shuffles plain tables and adaptive
execution splits the rows of a node with very many neighbours.

Where nodes are whole numbers, edges are dealt by ranges first and each task joins what its own
edges connect, in chunks of bounded size. Only what several chunks share is left for the steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.storage import forget, materialize


def _large_star(edges: DataFrame, held: list[DataFrame]) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    held.append(least)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(down: DataFrame, held: list[DataFrame]) -> DataFrame:
    """Of edges whose ``u`` is the larger end."""
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    held.append(least)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour and that one none: then it is the least of all
    that edges connect, and another round would change nothing."""
    n, different = edges.agg(F.count("*"), F.countDistinct("u")).first()
    return n == different and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


#: Edges that a task joins at once; about 100 bytes each while it does.
CHUNK = 1 << 21


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the nodes 0 to n - 1 that edges a-b connect each with."""
    label = np.arange(n)
    while True:
        a, b = label[a], label[b]
        open_ = a != b
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that edges u-v connect each with)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    return nodes, nodes[joined(len(nodes), at[: len(u)], at[len(u) :])]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the edges of each chunk."""

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in least_of(u, v)], ["node", "root"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield told(held)
            held, n = [], 0
    if n:
        yield told(held)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component) of every node that an edge names; component: the least node reachable.

    Edges that are null at an end are ignored, loops and repeated edges change nothing, and no
    edges give no rows. Nodes without an edge are the caller's to add.
    """
    kinds = {edges.schema[c].dataType.typeName() for c in (src, dst)}
    if not kinds <= {"byte", "short", "integer", "long"}:
        return _by_stars(edges, src, dst, rounds)
    kind = "bigint" if "long" in kinds else edges.schema[src].dataType.simpleString()
    named = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    given = materialize(named.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")), "edges")
    found = given.repartitionByRange("u").mapInArrow(_joined, "node long, root long")
    # a node has a root of each chunk that names it
    roots = materialize(found.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")), "roots")
    forget(given)
    links = materialize(roots.where(F.size("roots") > 1).select(F.explode("roots").alias("src"), F.col("root").alias("dst")).where("src <> dst").distinct(), "links")
    if links.isEmpty():
        return roots.select(F.col("node").cast(kind).alias("node"), F.col("root").cast(kind).alias("component"))
    least = materialize(_by_stars(links, "src", "dst", rounds).toDF("root", "least"), "least")
    return roots.join(least, "root", "left").select(F.col("node").cast(kind).alias("node"), F.coalesce("least", "root").cast(kind).alias("component"))


def _by_stars(edges: DataFrame, src: str, dst: str, rounds: int) -> DataFrame:
    """``connected_components`` by star steps alone, of nodes of any type."""
    named = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    given = materialize(named.select(F.col(src).alias("u"), F.col(dst).alias("v")).distinct(), "edges")
    now = given.where("u <> v")
    for turn in range(rounds):
        held: list[DataFrame] = [now] if turn else []
        down = materialize(_large_star(now, held), "down")
        now = materialize(_small_star(down, held).distinct(), "star")
        for old in (*held, down):
            forget(old)
        if _are_stars(now):
            break
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    roots = now.select(F.col("v").alias("u"), "v")
    loops = given.where("u = v").select("u", "v")
    return now.union(roots).union(loops.join(now, "u", "left_anti").join(roots.select("u").distinct(), "u", "left_anti")).distinct().select(F.col("u").alias("node"), F.col("v").alias("component"))
