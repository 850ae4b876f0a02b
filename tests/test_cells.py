"""Voronoi cells cut many at once, without a join that sends neighbours to all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motefield.functions.box import Box
from motefield.operators import voronoi


def _atoms(spark, n):
    return spark.range(n).select(F.lit(1).alias("frame"), F.col("id").alias("atom"), *[(F.rand(k) * 10).alias(c) for k, c in enumerate("xyz")], (F.col("id") % 3 / 10).alias("radius"))


def test_neighbours_are_not_broadcast(spark, monkeypatch):
    """Lists of neighbours, whose size is not known before they are made, went through the driver to all tasks."""
    plans, write = [], voronoi.materialize
    monkeypatch.setattr(voronoi, "materialize", lambda df, tag: plans.append((tag, df._jdf.queryExecution().executedPlan().toString())) or write(df, tag))
    cells = voronoi.all_cells(_atoms(spark, 60), Box.cubic(10.0), 4.0)
    assert cells.count() == 60 and cells.agg(F.sum("volume")).first()[0] == pytest.approx(1000.0)
    made = [plan for tag, plan in plans if tag == "cells"]
    assert made and not any("collect_list" in p for p in made) and all(p.count("Join") <= 1 for p in made)  # that of frames with open cells
    plan = voronoi.radical_cells(_atoms(spark, 60), Box.cubic(10.0), 4.0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan


def _cut(places, radii=None, me=None, cutoff=3.0):
    """Cells of 0.5 about the origin, a list of neighbours each, whose ids are 0, 1, ..."""
    of = np.repeat(np.arange(len(places)), [len(p) for p in places])
    ids = np.concatenate([np.arange(len(p)) for p in places])
    away = np.array([q for p in places for q in p], dtype=float).reshape(-1, 3)
    radii = np.full(len(of), 0.5) if radii is None else np.concatenate(radii)
    return voronoi.cells(of, ids, away, radii, np.full(len(places), 99) if me is None else me, np.full(len(places), 0.5), cutoff, float(radii.max(initial=0.5)))


def test_cells_of_many_shapes_at_once():
    span = range(-2, 3)
    cubic = [(x, y, z) for x in span for y in span for z in span if (x, y, z) != (0, 0, 0)]  # other planes touch edges and corners
    dense = [p for p in cubic if sum(p) % 2 == 0 and sum(c * c for c in p) <= 8]  # four planes meet in some corners
    volume, closed, (of, _, area) = _cut([cubic, dense, [(1.0, 0.0, 0.0)], []])
    assert volume == pytest.approx([1.0, 2.0, 3.5 * 36, 216.0]) and closed.tolist() == [True, True, False, False]
    assert np.bincount(of).tolist() == [6, 12, 1] and area[of == 0] == pytest.approx(np.ones(6)) and area[of == 2] == pytest.approx([36.0])


def test_cells_of_which_nothing_is_left():
    """A neighbour after one in the same place ended the task; a slice without any cell had areas of another type."""
    volume, closed, (of, ids, area) = _cut([[(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)], [(0.2, 0.0, 0.0), (0.0, 1.0, 0.0)]], [np.array([0.5, 0.5]), np.array([2.5, 0.5])])
    # one of a smaller id has the first one's place; the plane of a large neighbour leaves nothing of the second
    assert volume[0] == 0 and closed[0] and 0 not in of and volume[1] == 0
    assert area.dtype == volume.dtype == np.float64 and len(area) == 0 and len(ids) == 0
