"""Cells of a frame in which the first cutoff holds nearly all particles."""

from pyspark.sql import functions as F

from motefield.functions.box import Box
from motefield.operators import voronoi


def test_crowded_frames_begin_with_a_smaller_cutoff(spark, monkeypatch):
    """Each cell was cut among all particles within the cutoff, so work grew with the square of a frame."""
    asked, image_pairs = [], voronoi._image_pairs
    monkeypatch.setattr(voronoi, "_image_pairs", lambda some, all_, box, cutoff, keys: asked.append(cutoff) or image_pairs(some, all_, box, cutoff, keys))
    atoms = spark.range(430).select(F.when(F.col("id") < 400, 1).otherwise(2).alias("frame"), F.col("id").alias("atom"), *[(F.rand(k) * 10).alias(c) for k, c in enumerate("xyz")], (F.col("id") % 3 / 10).alias("radius"))
    found = {r.frame: r for r in voronoi.all_cells(atoms, Box.cubic(10.0), 5.0).groupBy("frame").agg(F.count("*").alias("n"), F.sum("volume").alias("v")).collect()}
    assert found[1].n == 400 and found[2].n == 30 and all(abs(r.v - 1000) < 1e-6 for r in found.values())
    assert asked[0] < 5.0 and 5.0 in asked
