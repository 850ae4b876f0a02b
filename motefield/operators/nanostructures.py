"""Graphene sheets and carbon tubes: atoms by tiling, bonds by the lattice's own rule."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def graphene(spark: SparkSession, nx: int, ny: int, bond: float = 1.42) -> tuple[DataFrame, DataFrame]:
    """(atoms, bonds) of nx x ny rectangular cells of four atoms, periodic in x and y.

    Cells are 3 bonds long in x and sqrt(3) in y. Each bond of the lattice is one of six between
    an atom of a cell and one of the same or a next cell, so bonds need no search."""
    if nx < 1 or ny < 1:
        raise ValueError("at least one cell along each axis")
    rise = math.sqrt(3) * bond / 2
    places = [(0.0, 0.0), (bond / 2, rise), (1.5 * bond, rise), (2 * bond, 0.0)]
    cells = spark.range(nx * ny).select(F.floor(F.col("id") / ny).alias("i"), (F.col("id") % ny).alias("j"))
    spots = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("u"), F.lit(y).alias("v")) for k, (x, y) in enumerate(places)])
    atoms = cells.withColumn("s", F.explode(spots)).select(
        ((F.col("i") * ny + F.col("j")) * 4 + F.col("s.k")).alias("atom"), F.lit("C").alias("element"), (F.col("i") * (3 * bond) + F.col("s.u")).alias("x"), (F.col("j") * (2 * rise) + F.col("s.v")).alias("y"), F.lit(0.0).alias("z")
    )
    #: (atom, atom, cells on in x, cells on in y)
    links = [(0, 1, 0, 0), (1, 2, 0, 0), (2, 3, 0, 0), (1, 0, 0, 1), (2, 3, 0, 1), (3, 0, 1, 0)]
    ends = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip("abxy", link, strict=True)]) for link in links])
    number = lambda i, j, k: (F.pmod(i, F.lit(nx).cast("long")) * ny + F.pmod(j, F.lit(ny).cast("long"))) * 4 + k
    bonds = cells.withColumn("l", F.explode(ends)).select(number(F.col("i"), F.col("j"), F.col("l.a")).alias("atomi"), number(F.col("i") + F.col("l.x"), F.col("j") + F.col("l.y"), F.col("l.b")).alias("atomj"))
    return atoms, bonds


def carbon_tube(spark: SparkSession, n: int, m: int, cells: int = 1, bond: float = 1.42) -> DataFrame:
    """(atom, element, x, y, z, u, v) of an (n, m) tube along z: lattice points of the sheet whose
    place, in units of the chiral and the translation vector, lies in one cell, rolled up; u and
    v are those units, v counted over ``cells`` cells."""
    if n < 1 or m < 0 or m > n or cells < 1:
        raise ValueError("a tube needs n >= m >= 0, n and cells of at least 1")
    a = math.sqrt(3) * bond
    common = math.gcd(2 * n + m, 2 * m + n)
    t1, t2 = (2 * m + n) // common, -(2 * n + m) // common
    hexagons = n * t2 - m * t1  # negative: its size is the number of hexagons of a cell
    around, along = a * math.sqrt(n * n + n * m + m * m), a * math.sqrt(t1 * t1 + t1 * t2 + t2 * t2)
    low1, high1 = min(0, n, t1, n + t1) - 1, max(0, n, t1, n + t1) + 1
    low2, high2 = min(0, m, t2, m + t2) - 1, max(0, m, t2, m + t2) + 1
    span = high2 - low2 + 1
    grid = spark.range((high1 - low1 + 1) * span).select((F.floor(F.col("id") / span) + low1).alias("p"), (F.col("id") % span + low2).alias("q"))
    both = grid.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    # three times the lattice coordinates are whole numbers, so a point on a cell's edge is told exactly
    p, q = 3 * F.col("p") + F.col("s"), 3 * F.col("q") + F.col("s")
    u, v = p * t2 - q * t1, q * n - p * m
    sign = 1 if hexagons > 0 else -1
    size = 3 * abs(hexagons)
    inside = both.select((u * sign).alias("u"), (v * sign).alias("v")).where(f"u >= 0 and u < {size} and v >= 0 and v < {size}")
    rows = inside.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    turn, radius = F.col("u") * (2 * math.pi / size), around / (2 * math.pi)
    order = (F.col("c") * size + F.col("v")) * size + F.col("u")
    return rows.select(order.alias("atom"), F.lit("C").alias("element"), (F.cos(turn) * radius).alias("x"), (F.sin(turn) * radius).alias("y"), ((F.col("v") / size + F.col("c")) * along).alias("z"), (F.col("u") / size).alias("u"), (F.col("v") / size + F.col("c")).alias("v"))
