"""Radical Voronoi cells of particles in a periodic box, and what is summed over them.

A particle's neighbours within a cutoff are in its block of the cell join; the task that finds them cuts a
cube by the radical plane of each, nearest plane first, until no plane can reach the cell, many cells at
once in arrays. The work is local: a particle's neighbours are as many as the density allows. ``closed`` says
that neighbours within the cutoff were enough; where it is false a larger cutoff is needed,
which ``all_cells`` gives to these cells alone, round by round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.functions.box import Box
from motefield.operators.components import connected_components
from motefield.operators.neighbors import BLOCKS, ROWS, around, both_ways, cross_pairs, dealt_around, neighbor_pairs, starts, whole
from motefield.storage import materialize

#: About so many particles are within the first cutoff of a crowded frame.
NEIGHBOURS = 60

FREE = Box(((0.0, 0.0, 0.0),) * 3, (False, False, False))

#: Blocks of cells in which particles are dealt, smaller than those of pairs: few bytes are much work here.
DEALT = 4

#: Rows of neighbours that a task cuts by at once, unless one cell has more, and planes between two looks at what is done.
AT_ONCE, LOOK = 1 << 18, 6


def _cube() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corners, the three sides that meet in each, mates) of the cube from -1 to 1, whose sides are 0 to 5: x, y, z,
    low and high. Sides go round a corner as seen from outside; a half-edge 3 v + s of corner v goes from its side
    s to the next one, and its mate the other way at the edge's other corner."""
    corners, sides, at = [], [], {}
    for v in range(8):
        high = [v >> k & 1 for k in range(3)]
        x, y, z = (2 * k + h for k, h in enumerate(high))
        corners.append([2.0 * h - 1 for h in high])
        sides.append([x, y, z] if sum(high) % 2 else [x, z, y])
        at |= {(sides[v][s], sides[v][(s + 1) % 3]): 3 * v + s for s in range(3)}
    mates = [[at[t[(s + 1) % 3], t[s]] for s in range(3)] for t in sides]
    return np.array(corners), np.array(sides), np.array(mates)


def cells(of: np.ndarray, ids: np.ndarray, away: np.ndarray, radii: np.ndarray, me: np.ndarray, own: np.ndarray, cutoff: float, widest: float) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(volume, closed, faces) of cells about the origin, cut all at once; faces: (cell, neighbour, area), by cells.

    ``of``, ``ids``, ``away``, ``radii``: of neighbours, the cell's number, in order, and the neighbour's id, place
    and radius; ``me``, ``own``: of cells, id and radius; ``widest``: no radius is larger. An id may come
    several times, as images of one particle; each has a face of its own.

    A cell is a cube at first, held as its corners, in each of which three planes meet, and cut by one plane after
    the other. Corners beyond it go, and each edge that leaves them has a new one, between its two ends. A plane
    that only touches cuts nothing.
    """
    n, tiny = len(own), 1e-9 * cutoff
    square = (away**2).sum(axis=1)
    length = np.sqrt(square)
    plane = (square + own[of] ** 2 - radii**2) / 2 / np.where(length > 0, length, 1)
    # of particles in one place the one of larger radius, or the first, has the cell
    gone = np.zeros(n, dtype=bool)
    gone[of[(length == 0) & ((own[of] < radii) | (own[of] == radii) & (ids < me[of]))]] = True
    left = np.flatnonzero((length > 0) & ~gone[of])
    left = left[np.lexsort((plane[left], of[left]))]
    of, ids, plane, normal = of[left], ids[left], plane[left], away[left] / length[left, None]
    next_, end = (np.searchsorted(of, np.arange(n), side) for side in ("left", "right"))
    # planes are numbered over all cells, the sides of cubes first
    normals = np.concatenate([np.tile(np.repeat(np.eye(3), 2, axis=0) * np.array([-1.0, 1.0] * 3)[:, None], (n, 1)), normal])
    offsets = np.concatenate([np.full(6 * n, float(cutoff)), plane])
    corners, sides, mates = _cube()
    going = np.flatnonzero(~gone)
    shift = np.arange(len(going))[:, None, None]
    x, cell = np.tile(corners * cutoff, (len(going), 1)), np.repeat(going, 8)
    tri, mate = (sides + 6 * going[:, None, None]).reshape(-1, 3), (mates + 24 * shift).reshape(-1, 3)
    dead = np.zeros(len(x), dtype=bool)
    far, open_ = np.zeros(n), np.zeros(n, dtype=bool)
    ends, areas = [], []
    while len(x):
        for _ in range(LOOK):
            has = next_ < end
            at = np.where(has, next_, 0)
            high = (x * normal[at][cell]).sum(axis=1) - np.where(has, plane[at], np.inf)[cell] if len(plane) else np.full(len(x), -np.inf)
            next_ = next_ + has
            beyond = (high > tiny) & ~dead
            out = np.flatnonzero(beyond)
            if not len(out):
                continue
            rim, slot = np.nonzero(~beyond[mate[out] // 3])
            rim = out[rim]
            other = mate[rim, slot]
            kept = other // 3
            part = high[rim] / (high[rim] - np.minimum(high[kept], 0))
            a, b = tri[rim, slot], tri[rim, (slot + 1) % 3]
            fresh = len(x) + np.arange(len(rim))
            x = np.concatenate([x, x[rim] + (x[kept] - x[rim]) * part[:, None]])
            tri = np.concatenate([tri, np.stack([a, b, 6 * n + at[cell[rim]]], axis=1)])
            cell, dead = np.concatenate([cell, cell[rim]]), np.concatenate([dead, np.zeros(len(rim), dtype=bool)])
            mate.reshape(-1)[other] = 3 * fresh
            mate = np.concatenate([mate, np.stack([other, other, other], axis=1)])
            # round the new face: where one of its edges leaves a plane another one enters it
            enters, leaves = fresh[np.argsort(b, kind="stable")], fresh[np.argsort(a, kind="stable")]
            mate[enters, 1], mate[leaves, 2] = 3 * leaves + 2, 3 * enters + 1
            dead[out] = True
        alive = np.flatnonzero(~dead)
        reach = np.zeros(n)
        np.maximum.at(reach, cell[alive], (x[alive] ** 2).sum(axis=1))
        reach = np.sqrt(reach)
        more = next_ < end
        more[more] = plane[next_[more]] < reach[more]
        done = alive[~more[cell[alive]]]
        far[cell[done]] = reach[cell[done]]
        open_[cell[done[(tri[done] < 6 * n).any(axis=1)]]] = True
        for s in range(3):
            to = tri[done, (s + 1) % 3]
            ends.append(to)
            areas.append((np.cross(x[done], x[mate[done, s] // 3]) * normals[to]).sum(axis=1) / 2)
        stay = alive[more[cell[alive]]]
        number = np.empty(len(x), dtype=np.int64)
        number[stay] = np.arange(len(stay))
        x, cell, tri, mate, dead = x[stay], cell[stay], tri[stay], 3 * number[mate[stay] // 3] + mate[stay] % 3, dead[stay]
    # the zeros put first keep it a number with a fraction where no cell is left
    area = np.bincount(np.concatenate([np.arange(len(offsets)), *ends]), np.concatenate([np.zeros(len(offsets)), *areas]), len(offsets))
    volume = np.bincount(np.concatenate([np.repeat(np.arange(n), 6), of]), area * offsets / 3, n)
    told = np.flatnonzero(area[6 * n :] > tiny**2)
    return volume, ~open_ & (far <= (cutoff**2 + own**2 - widest**2) / (2 * cutoff)) | (far == 0), (of[told], ids[told], area[6 * n + told])


def _told(keys: list[str], held: pa.Table, rows: np.ndarray, made: tuple) -> pa.RecordBatch:
    """Cells of these rows of a table as a batch."""
    volume, closed, (of, neighbour, area) = made
    bounds = pa.array(np.searchsorted(of, np.arange(len(rows) + 1)).astype(np.int32))
    faces = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(neighbour), pa.array(area)], ["neighbour", "area"]))
    named = [held[c].combine_chunks().take(pa.array(rows)) for c in (*keys, "atom")]
    return pa.RecordBatch.from_arrays([*named, pa.array(volume), faces, pa.array(closed)], [*keys, "atom", "volume", "faces", "closed"])


def _schema(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*keys, "atom"]) + ", volume double, faces array<struct<neighbour:bigint,area:double>>, closed boolean"


def _tasks(rows: DataFrame) -> int:
    """A fixed number, as adaptive execution would join tasks by their few bytes."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def radical_cells(atoms: DataFrame, box: Box, cutoff: float, radius: str = "radius", keys=("frame",)) -> DataFrame:
    """(keys, atom, volume, faces: array of (neighbour, area), closed) of atoms (keys, atom, x,
    y, z, radius). The volumes of a frame whose cells are all closed sum to the box. Of atoms
    in one place the one of larger radius, or the first, has the cell."""
    keys = list(keys)
    widest = float(atoms.agg(F.max(radius)).first()[0] or 0.0)
    held = atoms.withColumn("_r", F.coalesce(F.col(radius).cast("double"), F.lit(0.0)))
    near = both_ways(neighbor_pairs(held, box, cutoff, keys=keys, carry=("_r",)), carry=("_r",))
    # a row of each atom's own with those of its neighbours: nothing is joined, so nothing is sent to all
    nothing = [F.lit(None).cast(near.schema[c].dataType).alias(c) for c in ("j", "dx", "dy", "dz", "_r_j")]
    rows = near.select(*keys, F.col("i").alias("atom"), F.col("_r_i").alias("_r"), "j", "dx", "dy", "dz", "_r_j").unionByName(held.select(*keys, "atom", "_r", *nothing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole(batches, [*keys, "atom"], AT_ONCE):
            edge = starts(held, [*keys, "atom"])
            first = np.flatnonzero(edge)
            mine = held.filter(pc.is_valid(held["j"]))
            of = (np.cumsum(edge) - 1)[pc.is_valid(held["j"]).to_numpy()]
            ids, radii, *away = (mine[c].to_numpy() for c in ("j", "_r_j", "dx", "dy", "dz"))
            me, own = (held[c].to_numpy()[first] for c in ("atom", "_r"))
            yield _told(keys, held, first, cells(of, ids, np.stack(away, axis=1), radii, me, own, cutoff, widest))

    return rows.repartition(_tasks(rows), *keys, "atom").sortWithinPartitions(*keys, "atom").mapInArrow(run, _schema(rows, keys))


def _image_pairs(some: DataFrame, all_: DataFrame, box: Box, cutoff: float, keys: list[str]) -> DataFrame:
    """Rows of ``some`` (``_home``) and all images of ``all_``, dealt by blocks in which each of those rows has
    all that are within the cutoff, images of its own included."""
    counts = [math.ceil(cutoff / d) for d in box.face_distances]
    place = lambda f: [sum((F.lit(float(box.matrix[r][k])) * f[k] for k in range(3)), F.lit(float(box.origin[r]))).alias(c) for r, c in enumerate("xyz")]

    def wrapped(df: DataFrame) -> DataFrame:
        inside = [v - F.floor(v) for v in box.fractional(("x", "y", "z"))]
        return df.select(*keys, "atom", "_r", *[v.alias(f"_f{k}") for k, v in enumerate(inside)])

    moved = wrapped(all_)
    for k, (n, d) in enumerate(zip(counts, box.face_distances, strict=True)):
        margin = cutoff / d
        moved = moved.withColumn(f"_s{k}", F.explode(F.sequence(F.lit(-n), F.lit(n)))).withColumn(f"_f{k}", F.col(f"_f{k}") + F.col(f"_s{k}"))
        moved = moved.where(F.col(f"_f{k}").between(-margin - 1e-9, 1 + margin + 1e-9))
    images = moved.select(*keys, "atom", "_r", (F.abs("_s0") + F.abs("_s1") + F.abs("_s2")).alias("_away"), *place([F.col(f"_f{k}") for k in range(3)]))
    own = wrapped(some)
    centers = own.select(*keys, "atom", "_r", F.lit(0).alias("_away"), *place([F.col(f"_f{k}") for k in range(3)]))
    return dealt_around(centers, images, FREE, cutoff, keys, carry=("_r", "_away"), size=DEALT, tasks=_tasks(some))


def _cells(dealt: DataFrame, cutoff: float, widest: float, keys: list[str]) -> DataFrame:
    """Cells of the rows of ``dealt`` that are ``_home`` among those that are not."""
    dealt = dealt.withColumnRenamed("_id", "atom")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole(batches, [*keys, *BLOCKS], ROWS):
            atom, away, radius = (held[c].to_numpy() for c in ("atom", "_away", "_r"))
            for mine, i, j, d, _ in around(held, FREE, cutoff, [None] * 3, keys, True, DEALT, AT_ONCE):
                other = (atom[i] != atom[j]) | (away[j] > 0)
                i, j, d = i[other], j[other], np.stack([c[other] for c in d], axis=1)
                yield _told(keys, held, mine, cells(np.searchsorted(mine, i), atom[j], d, radius[j], atom[mine], radius[mine], cutoff, widest))

    return dealt.mapInArrow(run, _schema(dealt, keys))


def all_cells(atoms: DataFrame, box: Box, cutoff: float, radius: str = "radius", keys=("frame",), growth: float = 1.5) -> DataFrame:
    """``radical_cells`` in which every cell is closed, of a box that is periodic along all axes.

    Cells that the cutoff leaves open are made anew with one ``growth`` times as large, among all images of the
    particles of their frames, own ones included, until none is open; the others are not touched again. So the
    first cutoff changes the work and not the result, and a box of few particles has whole cells too. Frames
    in which it holds far more than ``NEIGHBOURS`` particles begin with a smaller one. Rows
    with a null coordinate have no cell.
    """
    if not all(box.pbc) or box.style == "free":
        raise ValueError("cells at a free side have no end: the box must be periodic along all axes")
    if cutoff <= 0 or growth <= 1:
        raise ValueError("the cutoff must be positive and grow")
    keys = list(keys)
    widest = float(atoms.agg(F.max(radius)).first()[0] or 0.0)
    held = materialize(atoms.where("atom is not null and x is not null and y is not null and z is not null").withColumn("_r", F.coalesce(F.col(radius).cast("double"), F.lit(0.0))).select(*keys, "atom", "x", "y", "z", "_r"), "particles")
    # a crowded frame begins with a smaller cutoff, by as many powers of the growth as leave about so many neighbours
    crowd = F.log(F.count("*") * (4 / 3 * math.pi * cutoff**3 / NEIGHBOURS / box.volume)) / (3 * math.log(growth))
    level = held.groupBy(*keys).agg(F.greatest(F.floor(crowd), F.lit(0)).cast("int").alias("_level"))
    held = materialize(held.join(materialize(level, "levels"), keys) if keys else held.join(F.broadcast(level), F.lit(True)), "particles")
    starts = {0} | {r["_level"] for r in held.select("_level").distinct().collect()}  # as many as a logarithm
    now, open_, closed = max(starts), None, []
    while now >= 0 or open_ is not None:
        if now in starts:
            fresh = held.where(F.col("_level") == now)
            open_ = fresh if open_ is None else open_.union(fresh)
        if open_ is not None:
            reach = cutoff * growth**-now
            frames = held.join(open_.select(*keys).distinct(), keys, "left_semi") if keys else held
            made = materialize(_cells(_image_pairs(open_, frames, box, reach, keys), reach, widest, keys), "cells")
            closed.append(made.where("closed"))
            left = made.where("not closed")
            open_ = None if left.isEmpty() else materialize(open_.join(left.select(*keys, "atom").hint("merge"), [*keys, "atom"], "left_semi"), "open")
        now -= 1
    return reduce(DataFrame.union, closed)


def _adjacent(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.select(*keys, F.col("atom").alias("i"), F.explode("faces").alias("f")).select(*keys, "i", F.col("f.neighbour").alias("j")).where("i < j")


def domains(cells: DataFrame, labels: DataFrame, label: str = "label", keys=("frame",)) -> DataFrame:
    """(keys, atom, label, domain, volume): cells of one label that faces join are one domain,
    named by its least atom. ``labels``: (keys, atom, label); cells without one are left out."""
    keys = list(keys)
    told = labels.where(F.col(label).isNotNull()).select(*keys, "atom", F.col(label).alias("_l"))
    like = (
        _adjacent(cells, keys).join(told.withColumnsRenamed({"atom": "i", "_l": "_p"}), [*keys, "i"]).join(told.withColumnsRenamed({"atom": "j", "_l": "_q"}), [*keys, "j"]).where("_p = _q")
    )
    node = lambda c: F.struct(*keys, F.col(c).alias("atom"))
    found = connected_components(like.select(node("i").alias("src"), node("j").alias("dst")))
    named = found.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.atom").alias("atom"), F.col("component.atom").alias("domain"))
    return cells.select(*keys, "atom", "volume").join(told, [*keys, "atom"]).join(named, [*keys, "atom"], "left").select(*keys, "atom", F.col("_l").alias(label), F.coalesce("domain", "atom").alias("domain"), "volume")


def domain_sizes(found: DataFrame, label: str = "label", keys=("frame",)) -> DataFrame:
    """(keys, label, domain, cells, volume, share): ``share`` of the label's cells in the frame."""
    sizes = found.groupBy(*keys, label, "domain").agg(F.count("*").alias("cells"), F.sum("volume").alias("volume"))
    whole = sizes.groupBy(*keys, label).agg(F.sum("cells").alias("_n"))
    return sizes.join(whole, [*keys, label]).withColumn("share", F.col("cells") / F.col("_n")).drop("_n")


def voids(cells: DataFrame, empty: Column, keys=("frame",)) -> DataFrame:
    """(keys, cavity, cells, volume, fraction): cells of a mask that faces join are a cavity;
    ``fraction`` of the volume of all cells of the frame. ``empty`` is a Column of ``cells``."""
    keys = list(keys)
    marked = cells.where(empty).select(*keys, "atom", F.lit(1).alias("label"))
    whole = cells.groupBy(*keys).agg(F.sum("volume").alias("_v"))
    sizes = domains(cells, marked, keys=keys).groupBy(*keys, F.col("domain").alias("cavity")).agg(F.count("*").alias("cells"), F.sum("volume").alias("volume"))
    return sizes.join(whole, keys).withColumn("fraction", F.col("volume") / F.col("_v")).drop("_v")


def integrate_density(grid: DataFrame, atoms: DataFrame, box: Box, cutoff: float, voxel: float, radius: str = "radius", keys=("frame",)) -> DataFrame:
    """(keys, mol, charge, mx, my, mz): each voxel's density belongs to the atom of the nearest
    radical cell, and that to its molecule; charge is that of nuclei less electrons, the dipole
    is about the molecule's least atom. ``grid``: (keys, voxel, x, y, z, density), ``atoms``:
    (keys, atom, mol, x, y, z, radius, nuclear), ``voxel`` is a voxel's volume. A voxel without an atom
    within the cutoff is an error, as its electrons would be lost."""
    keys = list(keys)
    points = grid.select(*keys, F.col("voxel").alias("atom"), "x", "y", "z", "density", F.lit(0.0).alias("_r"))
    held = atoms.withColumn("_r", F.coalesce(F.col(radius).cast("double"), F.lit(0.0)))
    near = cross_pairs(points, held.withColumn("density", F.lit(0.0)), box, cutoff, keys=keys, carry=("_r", "density"))
    owner = near.groupBy(*keys, F.col("i").alias("voxel")).agg(F.min_by(F.struct("j", "dx", "dy", "dz"), F.struct(F.col("dist") ** 2 - F.col("_r_j") ** 2, "j")).alias("o"), F.first("density_i").alias("density"))
    owned = grid.select(*keys, "voxel").join(owner, [*keys, "voxel"], "left")
    sure = F.when(F.col("o").isNull(), F.raise_error(F.lit("a voxel has no atom within the cutoff")).cast("bigint")).otherwise(F.col("o.j"))
    cloud = owned.select(*keys, sure.alias("atom"), (-F.col("density") * voxel).alias("q"), *[(-F.col(f"o.d{c}")).alias(f"o{c}") for c in "xyz"])
    first = held.groupBy(*keys, "mol").agg(F.min_by(F.struct("x", "y", "z"), "atom").alias("_s"))
    placed = held.join(first, [*keys, "mol"])
    shift = box.minimum_image(tuple(F.col(c) - F.col(f"_s.{c}") for c in "xyz"))
    placed = placed.select(*keys, "mol", "atom", "nuclear", *[v.alias(f"s{c}") for c, v in zip("xyz", shift, strict=True)])
    zero = F.lit(0.0)
    nuclei = placed.select(*keys, "mol", F.col("nuclear").cast("double").alias("q"), *[F.col(f"s{c}").alias(f"p{c}") for c in "xyz"])
    electrons = cloud.join(placed, [*keys, "atom"]).select(*keys, "mol", "q", *[(F.col(f"s{c}") + F.col(f"o{c}")).alias(f"p{c}") for c in "xyz"])
    return nuclei.union(electrons).groupBy(*keys, "mol").agg(F.coalesce(F.sum("q"), zero).alias("charge"), *[F.sum(F.col("q") * F.col(f"p{c}")).alias(f"m{c}") for c in "xyz"])
