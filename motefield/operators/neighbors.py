"""Neighbour joins: pairs of points within a cutoff under a box.

Space is cut into cells somewhat wider than the cutoff, and cells into blocks of a fixed number of
them. Rows are dealt by frame and block, those at a block's rim to the blocks next to it as
well, so about one row a point is shuffled. A task then looks into the cells around each of its
points, many blocks at once in arrays; a pair arises in the block of its first point. A range
predicate instead would be planned as a Cartesian product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from motefield.functions.box import Box

XYZ = ("x", "y", "z")
BLOCKS = ["_bx", "_by", "_bz"]

#: Cells of a block along each axis.
BLOCK = 16

#: Cells are so much wider than the cutoff that rounding leaves no pair within it two cells apart, up to
#: coordinates of about 1e11 cutoffs.
WIDER = 1.001

#: Rows that a task takes at once, if a block has no more, and pairs that it compares at once.
ROWS, MOST = 1 << 17, 1 << 21


def _grid(box: Box, cutoff: float) -> list[int | None]:
    """Cells along each axis; None where the axis is free and cells are not wrapped."""
    if box.style == "free":
        return [None] * 3
    return [max(1, int(d / (cutoff * WIDER))) if p else None for d, p in zip(box.face_distances, box.pbc, strict=True)]


def _cells(box: Box, cutoff: float, grid: list[int | None]) -> list[Column]:
    if box.style == "free":
        return [F.floor(F.col(c) / (cutoff * WIDER)) for c in XYZ]
    out = []
    for frac, n, d in zip(box.fractional(XYZ), grid, box.face_distances, strict=True):
        out.append(F.floor(frac * (d / (cutoff * WIDER))) if n is None else F.least(F.floor((frac - F.floor(frac)) * n), F.lit(n - 1).cast("long")))
    return out


def _dealt(df: DataFrame, box: Box, cutoff: float, grid: list[int | None], keys, atom: str, carry, around: bool, size: int = BLOCK) -> DataFrame:
    """(keys, block, _c, _home, _id, x, y, z, carry): each row in its own block or, with ``around``, in each block
    that its cell borders on; ``_c``: its cell's number there."""
    known = df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in (*keys, *XYZ)]))
    rows = known.select(*keys, F.col(atom).alias("_id"), *[F.col(c).cast("double").alias(c) for c in XYZ], *carry, *[c.alias(n) for n, c in zip(("_cx", "_cy", "_cz"), _cells(box, cutoff, grid), strict=True)])
    place, home = F.lit(0).cast("long"), F.lit(True)
    for c, b, n, d in zip(("_cx", "_cy", "_cz"), BLOCKS, grid, _extent(grid, size), strict=True):
        at = lambda v, n=n: F.floor((F.pmod(v, F.lit(n).cast("long")) if n else v) / size)
        if n and n <= size:
            rows = rows.withColumn(b, F.lit(0).cast("long"))
        elif around:
            rows = rows.withColumn(b, F.explode(F.array_distinct(F.array(at(F.col(c)), at(F.col(c) - 1), at(F.col(c) + 1)))))
            home = home & (F.col(b) == at(F.col(c)))
        else:
            rows = rows.withColumn(b, at(F.col(c)))
        within = F.col(c) - F.col(b) * size + 1
        place = place * d + (F.pmod(within, F.lit(n).cast("long")) if n else within)
    return rows.select(*keys, *BLOCKS, place.alias("_c"), home.alias("_home"), "_id", *XYZ, *carry)


def _extent(grid: list[int | None], size: int = BLOCK) -> list[int]:
    """Cells of a block with those around it, along each axis."""
    return [min(n, size + 2) if n else size + 2 for n in grid]


def _sum(terms: list[np.ndarray], like: np.ndarray) -> np.ndarray:
    return reduce(np.add, terms) if terms else np.zeros_like(like)


def _image(box: Box, d: list[np.ndarray]) -> list[np.ndarray]:
    """``Box.minimum_image`` of arrays, by the same operations."""
    if box.style == "free":
        return d
    if box.style == "orthogonal":
        return [c - box.matrix[k][k] * np.rint(c / box.matrix[k][k]) if box.pbc[k] else c for k, c in enumerate(d)]
    linear = lambda m, x: [_sum([float(v) * c for v, c in zip(row, x, strict=True) if v], x[0]) for row in m]
    back = [np.rint(f) if p else np.zeros_like(f) for f, p in zip(linear(np.linalg.inv(np.array(box.matrix)), d), box.pbc, strict=True)]
    return [c - s for c, s in zip(d, linear(np.array(box.matrix), back), strict=True)]


def _numbers(ids: pa.Array) -> np.ndarray:
    """Whole numbers in the order of the ids."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False)
    return np.unique(np.array(ids.to_pylist()), return_inverse=True)[1]


def starts(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; nulls always do."""
    edge = np.ones(rows.num_rows, dtype=bool)
    differs = [pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False) for c in (rows[name].combine_chunks() for name in columns)]
    edge[1:] = reduce(np.logical_or, differs) if differs else False
    return edge


def whole(batches: Iterator[pa.RecordBatch], columns: list[str], most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` rows of sorted batches, in which rows that are equal in the columns are together."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            # up to where the last group begins
            rows = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(starts(rows, columns))[-1])
            if cut:
                yield rows.slice(0, cut).combine_chunks()
                held, n = rows.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def around(rows: pa.Table, box: Box, cutoff: float, grid: list[int | None], keys: list[str], apart: bool, size: int = BLOCK, most: int | None = None, number: np.ndarray | None = None) -> Iterator[tuple]:
    """(mine, i, j, d, square) of whole blocks: rows that are ``_home``, and of each all pairs within the cutoff, in order
    of i; so many at once that about ``most`` are compared. ``apart``: with rows that are not ``_home``, else with all;
    ``number``: only pairs in which j's is larger."""
    extent, most = _extent(grid, size), most or MOST
    home, cell = (rows[c].to_numpy() for c in ("_home", "_c"))
    at = (np.cumsum(starts(rows, [*keys, *BLOCKS])) - 1) * int(np.prod(extent))
    xyz = [rows[c].to_numpy() for c in XYZ]
    others = np.flatnonzero(~home) if apart else np.arange(rows.num_rows)
    order = others[np.argsort((at + cell)[others], kind="stable")]
    cells, first, count = np.unique((at + cell)[order], return_index=True, return_counts=True)
    first, count = np.append(first, 0), np.append(count, 0)
    steps = [sorted({o % d for o in (-1, 0, 1)}) if m and m < size + 2 else [-1, 0, 1] for m, d in zip(grid, extent, strict=True)]
    steps = np.array(list(product(*steps)))
    homes = np.flatnonzero(home)
    for begin in range(0, len(homes), 4096):
        mine = homes[begin : begin + 4096]
        where = np.unravel_index(cell[mine], extent)
        to = at[mine, None] + np.ravel_multi_index([(w[:, None] + s) % d for w, s, d in zip(where, steps.T, extent, strict=True)], extent)
        found = np.searchsorted(cells, to)
        found[(found == len(cells)) | (np.append(cells, -1)[found] != to)] = len(cells)
        upto = np.cumsum(count[found].sum(axis=1))
        # no more than so many at once, however many share a cell
        cuts = np.unique(np.concatenate([[0], np.searchsorted(upto, np.arange(most, int(upto[-1]), most), side="right"), [len(mine)]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k, start = count[found[a:b]].ravel(), first[found[a:b]].ravel()
            i = np.repeat(np.repeat(mine[a:b], len(steps)), k)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start, k)]
            if number is not None:
                once = number[i] < number[j]
                i, j = i[once], j[once]
            d = _image(box, [x[j] - x[i] for x in xyz])
            square = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
            near = square <= cutoff * cutoff
            yield mine[a:b], i[near], j[near], [c[near] for c in d], square[near]


def _searched(rows: pa.Table, box: Box, cutoff: float, grid: list[int | None], keys: list[str], carry: list[str], apart: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of whole blocks; ``apart``: of rows that are ``_home`` with those that are not."""
    held = {c: rows[c].combine_chunks() for c in rows.column_names}
    number = None if apart else _numbers(held["_id"])
    for _, i, j, d, square in around(rows, box, cutoff, grid, keys, apart, number=number):
        if len(i):
            p, q = pa.array(i), pa.array(j)
            told = [*(held[c].take(p) for c in keys), held["_id"].take(p), held["_id"].take(q), *map(pa.array, d), pa.array(np.sqrt(square))]
            told += [held[c].take(r) for r in (p, q) for c in carry]
            yield pa.RecordBatch.from_arrays(told, [*keys, "i", "j", "dx", "dy", "dz", "dist", *[f"{c}_{s}" for s in "ij" for c in carry]])


def _pairs(rows: DataFrame, box: Box, cutoff: float, grid: list[int | None], keys: list[str], carry, apart: bool) -> DataFrame:
    carry, kinds = list(carry), {f.name: f.dataType for f in rows.schema}
    told = [(k, kinds[k]) for k in keys] + [(c, kinds["_id"]) for c in "ij"] + [(c, DoubleType()) for c in ("dx", "dy", "dz", "dist")] + [(f"{c}_{s}", kinds[c]) for s in "ij" for c in carry]
    dealt = rows.repartition(*keys, *BLOCKS) if keys else rows.repartition(*BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole(batches, [*keys, *BLOCKS], ROWS):
            yield from _searched(held, box, cutoff, grid, keys, carry, apart)

    return dealt.sortWithinPartitions(*keys, *BLOCKS).mapInArrow(run, StructType([StructField(c, t) for c, t in told]))


def dealt_around(points: DataFrame, others: DataFrame, box: Box, cutoff: float, keys: list[str], carry, size: int, tasks: int) -> DataFrame:
    """Points (``_home``) and others as ``around`` takes them with ``apart``, in blocks of ``size`` cells and so many tasks."""
    grid = _grid(box, cutoff)
    left = _dealt(points, box, cutoff, grid, keys, "atom", carry, False, size)
    right = _dealt(others, box, cutoff, grid, keys, "atom", carry, True, size).withColumn("_home", F.lit(False))
    return left.union(right).repartition(tasks, *keys, *BLOCKS).sortWithinPartitions(*keys, *BLOCKS)


def neighbor_pairs(atoms: DataFrame, box: Box, cutoff: float, keys=("frame",), atom: str = "atom", carry=()) -> DataFrame:
    """(keys, i, j, dx, dy, dz, dist) of pairs i < j within ``cutoff``, each once; d is from i
    to j. Columns in ``carry`` appear as name_i and name_j. Rows with a null coordinate have no
    neighbours. The cutoff must not exceed half the least face distance of a periodic box.
    """
    keys, grid = list(keys), _grid(box, cutoff)
    rows = _dealt(atoms.where(F.col(atom).isNotNull()), box, cutoff, grid, keys, atom, carry, True)
    return _pairs(rows, box, cutoff, grid, keys, carry, False)


def cross_pairs(points: DataFrame, others: DataFrame, box: Box, cutoff: float, keys=("frame",), atom: str = "atom", carry=()) -> DataFrame:
    """(keys, i, j, dx, dy, dz, dist) of points i and others j within ``cutoff``."""
    keys, grid = list(keys), _grid(box, cutoff)
    left = _dealt(points, box, cutoff, grid, keys, atom, carry, False)
    right = _dealt(others, box, cutoff, grid, keys, atom, carry, True).withColumn("_home", F.lit(False))
    return _pairs(left.union(right), box, cutoff, grid, keys, carry, True)


def both_ways(pairs: DataFrame, carry=()) -> DataFrame:
    """Every pair from either end: one pass over the pairs that emits two rows each."""
    row = lambda a, b, s: F.struct(
        F.col(a).alias("i"), F.col(b).alias("j"), *[(F.col(d) * s).alias(d) for d in ("dx", "dy", "dz")], F.col("dist").alias("dist"),
        *[F.col(f"{c}_{a}").alias(f"{c}_i") for c in carry], *[F.col(f"{c}_{b}").alias(f"{c}_j") for c in carry],
    )
    inner = {"i", "j", "dx", "dy", "dz", "dist", *[f"{c}_{s}" for c in carry for s in "ij"]}
    keys = [c for c in pairs.columns if c not in inner]
    return pairs.select(*keys, F.explode(F.array(row("i", "j", 1.0), row("j", "i", -1.0))).alias("_p")).select(*keys, "_p.*")
