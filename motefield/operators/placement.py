"""Constraints on where points may lie: penalties by aggregate, gradients by column.

A region constraint is a Column predicate of a point's coordinates with a direction to leave
by; its penalty is the number of points that break it. ``both`` adds penalties and directions;
``either`` is met where one of the two is, and a whole set of points takes the cheaper one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.functions.box import Box
from motefield.operators.neighbors import neighbor_pairs

TINY = 1e-8


@dataclass(frozen=True)
class Constraint:
    """``penalties``: named sums over points; ``total``: the penalty as a Column of these;
    ``pushes``: for x, y, z, the move of a point as a Column of it and of these sums."""

    penalties: dict[str, Column]
    total: Column
    pushes: tuple[Column, Column, Column]

    def __and__(self, other: Constraint) -> Constraint:
        return Constraint(self.penalties | other.penalties, self.total + other.total, tuple(a + b for a, b in zip(self.pushes, other.pushes, strict=True)))

    def __or__(self, other: Constraint) -> Constraint:
        a, b = self.total, other.total
        chosen = tuple(F.when(a < b, p).when(b < a, q).otherwise((p + q) / 2) for p, q in zip(self.pushes, other.pushes, strict=True))
        return Constraint(self.penalties | other.penalties, F.least(a, b), chosen)


def _counted(broken: Column, pushes, name: str) -> Constraint:
    zero, name = F.lit(0.0), name.replace(".", "_")  # a dot would part a column's name
    return Constraint({name: F.count_if(broken).cast("double")}, F.col(name), tuple(F.when(broken, p).otherwise(zero) for p in pushes))


def _inside(origin, lengths) -> Column:
    spans = [(F.col(c) >= float(o)) & (F.col(c) <= float(o) + float(n)) for c, o, n in zip("xyz", origin, lengths, strict=True)]
    return spans[0] & spans[1] & spans[2]


def inside_box(lengths, origin=(0.0, 0.0, 0.0)) -> Constraint:
    """Points beyond a face move by one along its axis, back to the box."""
    pushes = [F.when(F.col(c) < float(o), 1.0).when(F.col(c) > float(o) + float(n), -1.0).otherwise(0.0) for c, o, n in zip("xyz", origin, lengths, strict=True)]
    return _counted(~_inside(origin, lengths), pushes, f"_in_box_{origin}_{lengths}")


def outside_box(lengths, origin=(0.0, 0.0, 0.0)) -> Constraint:
    """Points inside move by one towards the upper faces, those on one of these towards the lower."""
    pushes = [F.when(F.col(c) < float(o) + float(n), 1.0).when(F.col(c) > float(o), -1.0).otherwise(0.0) for c, o, n in zip("xyz", origin, lengths, strict=True)]
    return _counted(_inside(origin, lengths), pushes, f"_out_box_{origin}_{lengths}")


def _from(center) -> tuple[list[Column], Column]:
    d = [F.col(c) - float(o) for c, o in zip("xyz", center, strict=True)]
    return d, F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def inside_sphere(radius: float, center=(0.0, 0.0, 0.0)) -> Constraint:
    d, r = _from(center)
    return _counted(r > radius, [-x / (r + TINY) for x in d], f"_in_sphere_{radius}_{center}")


def outside_sphere(radius: float, center=(0.0, 0.0, 0.0)) -> Constraint:
    """The move has the sign that the minimisers expect: minus the direction from the centre."""
    d, r = _from(center)
    return _counted(r <= radius, [F.when(r > TINY, -x / F.greatest(r, F.lit(TINY))).otherwise(0.0) for x in d], f"_out_sphere_{radius}_{center}")


def penalty(points: DataFrame, constraint: Constraint, by=()) -> DataFrame:
    """(by, penalty): one aggregate over the points of each group."""
    sums = points.groupBy(*by).agg(*[c.alias(n) for n, c in constraint.penalties.items()])
    return sums.select(*by, constraint.total.alias("penalty"))


def gradient(points: DataFrame, constraint: Constraint, by=()) -> DataFrame:
    """Points with ``gx``, ``gy``, ``gz``; a group's sums decide between alternatives."""
    sums = points.groupBy(*by).agg(*[c.alias(n) for n, c in constraint.penalties.items()])
    held = points.join(sums, list(by)) if by else points.join(F.broadcast(sums), F.lit(True))  # one row
    moved = {f"g{c}": p for c, p in zip("xyz", constraint.pushes, strict=True)}
    return held.withColumns(moved).drop(*constraint.penalties)


def min_distance_penalty(points: DataFrame, least: float, box: Box, keys=("frame",)) -> DataFrame:
    """(keys, penalty): squares of what pairs lack to ``least``, by the cell join; groups without
    a pair that near are rows of 0."""
    near = neighbor_pairs(points, box, least, keys=keys).groupBy(*keys).agg(F.sum(F.pow(least - F.col("dist"), 2)).alias("penalty"))
    return points.select(*keys).distinct().join(near, list(keys), "left").fillna(0.0, ["penalty"])


def min_distance_gradient(points: DataFrame, least: float, box: Box, keys=("frame",), atom: str = "atom") -> DataFrame:
    """(keys, atom, gx, gy, gz): twice what each pair lacks, along the pair, for both of its
    points; points that lack nothing have zeros. Pairs in one place have no direction."""
    near = neighbor_pairs(points, box, least, keys=keys, atom=atom).where(F.col("dist") > TINY)
    pull = 2 * (least - F.col("dist")) / F.col("dist")
    one = near.select(*keys, F.col("i").alias(atom), *[(-pull * F.col(f"d{c}")).alias(f"g{c}") for c in "xyz"])
    two = near.select(*keys, F.col("j").alias(atom), *[(pull * F.col(f"d{c}")).alias(f"g{c}") for c in "xyz"])
    sums = one.union(two).groupBy(*keys, atom).agg(*[F.sum(f"g{c}").alias(f"g{c}") for c in "xyz"])
    return points.select(*keys, atom).join(sums, [*keys, atom], "left").fillna(0.0, ["gx", "gy", "gz"])


def tiled(points: DataFrame, number: int) -> DataFrame:
    """``number`` copies of a target's points with ``copy`` from 0: what is to be placed."""
    if number < 0:
        raise ValueError("a number of copies is not negative")
    return points.sparkSession.range(number).select(F.col("id").alias("copy")).crossJoin(points)
