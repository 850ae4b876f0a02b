"""Results that are divided by what the tables hold, not by given numbers."""

import random

import pytest
from pyspark.sql import functions as F

from motefield.functions.box import Box
from motefield.operators import dynamics, neighbors, structure


@pytest.mark.parametrize(("particles", "frames"), [(3, 5), (7, 12)])
def test_pair_survival_counts_particles_and_frames(spark, particles, frames):
    rows = [(i, 0, f, 1.0 if i else 99.0) for i in range(particles) for f in range(frames)]
    dist = spark.createDataFrame(rows, "i int, j int, frame int, dist double")
    c = {r.lag: r.c for r in dynamics.pair_survival(dist, None, None, 20.0, 60.0, 6).collect()}
    assert c == {lag: pytest.approx((particles - 1) / particles) if lag < frames else None for lag in range(7)}


def test_coordination_counts_neighbours_of_frames_of_any_size(spark):
    rng, box = random.Random(2), Box.cubic(10.0)
    rows = [(f, a, *[rng.uniform(0, 10) for _ in "xyz"]) for f, n in ((0, 300), (1, 60)) for a in range(n)]
    atoms = spark.createDataFrame(rows, "frame int, atom long, x double, y double, z double")
    pairs = neighbors.neighbor_pairs(atoms, box, 4.0)
    g = structure.rdf(pairs, atoms, box, 40, 4.0)
    n = structure.coordination(g, structure.density_around(atoms, box)).agg(F.max("n")).first()[0]
    assert n == pytest.approx(2 * pairs.count() / len(rows), rel=0.01)
