"""Minimisation, nanostructures, force-field edits and drawn sequences."""

import math

import pytest
from pyspark.sql import functions as F

from motefield.functions.box import Box
from motefield.operators import forcefield, generators, minimize, nanostructures, neighbors, trajectory


def test_minimum_of_springs(spark):
    """Two frames: a stretched triangle of springs, and one at rest that must not move."""
    start = [(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.6, 0.1, 0.0), (0, 2, 0.5, 1.4, 0.2), (1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 0.5, math.sqrt(3) / 2, 0.0)]
    atoms = spark.createDataFrame(start, "frame int, atom long, x double, y double, z double")
    box = Box.cubic(20.0)

    def slope(state):
        pairs = neighbors.neighbor_pairs(state, box, 5.0)  # the gradient is minus the force
        forces = forcefield.pair_forces(pairs, -4.0 * (F.col("dist") - 1.0))
        return forces.select("frame", "atom", *[F.col(f"f{c}").alias(f"g{c}") for c in "xyz"])

    seen = []
    done = minimize.minimize(atoms, slope, fmax=0.01, steps=30, memory=4, longest=0.3, every=lambda k, _: seen.append(k)).cache()
    assert done.agg(F.max("fmax")).first()[0] <= 0.01 and seen == list(range(1, len(seen) + 1)) and len(seen) < 30
    assert done.where("frame = 1").agg(F.max("steps")).first()[0] == 0
    found = neighbors.neighbor_pairs(done.select("frame", "atom", "x", "y", "z"), box, 5.0)
    assert [r.dist for r in found.collect()] == pytest.approx([1.0] * 6, abs=0.005)


def test_graphene_and_tubes(spark):
    atoms, bonds = nanostructures.graphene(spark, 4, 3)
    assert atoms.count() == 48 and bonds.count() == 72
    box = Box.orthogonal(4 * 3 * 1.42, 3 * math.sqrt(3) * 1.42, 20.0)
    near = neighbors.neighbor_pairs(atoms.withColumn("frame", F.lit(0)), box, 1.6)
    told = sorted(tuple(sorted((r.atomi, r.atomj))) for r in bonds.collect())
    assert sorted((r.i, r.j) for r in near.collect()) == told
    for n, m in ((5, 5), (6, 0), (4, 2)):
        tube = nanostructures.carbon_tube(spark, n, m, 2)
        common = math.gcd(2 * n + m, 2 * m + n)
        assert tube.count() == 2 * 4 * (n * n + n * m + m * m) // common
        radius = math.sqrt(3) * 1.42 * math.sqrt(n * n + n * m + m * m) / (2 * math.pi)
        assert tube.agg(F.max(F.abs(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) - radius))).first()[0] < 1e-9
        length = 2 * math.sqrt(3) * 1.42 * math.sqrt(3 * (n * n + n * m + m * m)) / common
        wide = Box.orthogonal(60.0, 60.0, length)
        pairs = neighbors.neighbor_pairs(tube.withColumn("frame", F.lit(0)), wide, 1.55)
        assert pairs.count() == tube.count() * 3 // 2, (n, m)


def test_scaled_pairs_and_annotations(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0, 3.0), ("a", "c", 2.0, 3.0), ("c", "c", 5.0, 4.0)], "i string, j string, epsilon double, sigma double")
    fragments = spark.createDataFrame([("a", "x"), ("b", "y")], "type string, fragment string")
    factors = spark.createDataFrame([("y", "x", 0.5)], "fragment_i string, fragment_j string, k double")
    got = {(r.i, r.j): (r.epsilon, r.sigma) for r in forcefield.scale_lj(pairs, fragments, factors, 0.9).collect()}
    assert got == {("a", "b"): (0.5, pytest.approx(2.7)), ("a", "c"): (2.0, 3.0), ("c", "c"): (5.0, 4.0)}
    rows = spark.createDataFrame([(0, "old"), (1, "old")], "atom long, type string")
    match = spark.createDataFrame([(0, "C", 1.5), (1, None, 2.5), (2, "H", 0.0)], "atom long, type string, charge double")
    assert sorted(map(tuple, forcefield.write_onto(rows, match).collect())) == [(0, "C", 1.5), (1, "old", 2.5)]
    with pytest.raises(Exception, match="cover"):
        forcefield.write_onto(rows, match.where("atom = 0")).collect()


def test_more_potentials_and_sequences(spark):
    lit = F.lit
    row = spark.range(1).select(
        forcefield.fourier_torsion(lit(0.3), [(lit(2.0), 1, lit(0.0)), (lit(1.0), 2, lit(math.pi))]).alias("f"), forcefield.charmm_torsion(lit(0.3), lit(2.0), lit(3), lit(0.1)).alias("c"),
        forcefield.cvff_improper(lit(0.3), lit(2.0), lit(-1), lit(2)).alias("i"), forcefield.class2_bond_bond(lit(1.1), lit(1.2), lit(3.0), lit(1.0), lit(1.0)).alias("b"),
        forcefield.class2_bond_angle(lit(1.1), lit(1.2), lit(2.0), lit(1.0), lit(2.0), lit(1.0), lit(1.0), lit(1.5)).alias("a"), forcefield.damped_coulomb(lit(2.0), lit(1.0), lit(-1.0), lit(0.5)).alias("d"),
    ).first()
    assert (row.f, row.c, row.i) == pytest.approx((2 * (1 + math.cos(0.3)) + 1 + math.cos(0.6 - math.pi), 2 * (1 + math.cos(0.8)), 2 * (1 - math.cos(0.6))))
    assert (row.b, row.a, row.d) == pytest.approx((0.06, 0.25, -332.06371 / 4))
    drawn = spark.range(400).select(F.explode(generators.weighted_sequence({"A": 3.0, "B": 1.0}, lit(20), F.col("id"))).alias("u"))
    share = drawn.agg(F.avg((F.col("u") == "A").cast("int"))).first()[0]
    assert abs(share - 0.75) < 0.02
    frames = spark.range(6).select((F.col("id") % 2).alias("frame"), F.col("id").cast("double").alias("x"))
    assert sorted(r.x for r in trajectory.map_frames(frames, lambda df: df.assign(x=df.x - df.x.mean()), "frame long, x double").collect()) == [-2.0, -2.0, 0.0, 0.0, 2.0, 2.0]
