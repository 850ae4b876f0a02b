"""Neighbours by blocks and components by chunks, against plain ones."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from motefield.functions.box import Box
from motefield.operators import components, neighbors

BOXES = {
    "long": Box.orthogonal(40.0, 7.0, 3.0), "rim": Box.orthogonal(17.0, 18.5, 2.0), "mixed": Box.orthogonal(35.0, 5.0, 6.0, pbc=(False, True, True), origin=(-3.0, 1.0, 0.0)),
    "tilted": Box.triclinic((36.0, 19.0, 5.0), (2.0, 1.0, 0.5)), "free": Box(((0.0, 0.0, 0.0),) * 3, (False, False, False)),
}


def _near(box, p, q, cutoff):
    d = np.subtract(q, p)
    if box.style != "free":
        m = np.array(box.matrix)
        f = np.linalg.inv(m) @ d
        d = d - m @ np.where(box.pbc, np.rint(f), 0)
    return d @ d <= cutoff**2


@pytest.mark.parametrize("name", sorted(BOXES))
def test_blocks_lose_no_pair(spark, name):
    rng, box = random.Random(3), BOXES[name]
    rows = [(f, a, *(rng.uniform(-6, 46) if c == 0 else rng.uniform(-2, 20) for c in range(3))) for f in range(3) for a in range(150)]
    atoms = spark.createDataFrame(rows, "frame int, atom long, x double, y double, z double")
    want = {(p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and _near(box, p[2:], q[2:], 1.0)}
    found = [(r.frame, r.i, r.j) for r in neighbors.neighbor_pairs(atoms, box, 1.0).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    some = atoms.where("atom < 40")
    crossed = [(r.frame, r.i, r.j) for r in neighbors.cross_pairs(some, atoms, box, 1.0).collect()]
    both = {(f, i, j) for f, i, j in want if i < 40} | {(f, j, i) for f, i, j in want if j < 40} | {(p[0], p[1], p[1]) for p in rows if p[1] < 40}
    assert len(crossed) == len(set(crossed)) and set(crossed) == both


def test_pairs_shuffle_each_point_about_once(spark):
    """The cell join dealt every point 14 times."""
    atoms = spark.range(1000).selectExpr("0 AS frame", "id AS atom", "rand(1) * 50 AS x", "rand(2) * 11 AS y", "rand(3) * 9 AS z")
    grid = neighbors._grid(Box.orthogonal(50.0, 11.0, 9.0), 1.5)
    assert neighbors._dealt(atoms, Box.orthogonal(50.0, 11.0, 9.0), 1.5, grid, ["frame"], "atom", (), True).count() < 1300
    plan = neighbors.neighbor_pairs(atoms, Box.orthogonal(50.0, 11.0, 9.0), 1.5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_slices_and_chunks_change_nothing(monkeypatch):
    box = Box.cubic(8.0)
    rng = np.random.default_rng(5)
    n = 90
    rows = pa.table({"frame": np.repeat([1, 2, 3], n // 3), **{b: np.zeros(n, dtype=np.int64) for b in neighbors.BLOCKS}, "_c": rng.integers(0, 512, n) % 3, "_home": np.ones(n, dtype=bool), "_id": np.arange(n), **{c: rng.uniform(0, 1, n) for c in "xyz"}})
    take = lambda: sorted(t for b in neighbors._searched(rows, box, 1.0, [8, 8, 8], ["frame"], [], False) for t in zip(*(b[c].to_pylist() for c in ("frame", "i", "j", "dist")), strict=True))
    whole = take()
    monkeypatch.setattr(neighbors, "MOST", 7)
    assert whole and take() == whole and len({t[:3] for t in whole}) == len(whole) and all(math.isfinite(t[3]) for t in whole)


def test_components_of_near_ids_need_few_tables(spark, monkeypatch):
    """Star steps alone wrote four tables a round."""
    tags, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, tag: tags.append(tag) or write(df, tag))
    chains = spark.range(3000).where("id % 100 <> 99").selectExpr("id AS src", "id + 1 AS dst")
    found = {r.node: r.component for r in components.connected_components(chains).collect()}
    assert found == {i: i - i % 100 for i in range(3000)} and len(tags) <= 12


def test_least_of_random_edges():
    rng = np.random.default_rng(2)
    for n, m in ((5, 3), (40, 25), (300, 280), (50, 400)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        least = {int(k): int(k) for k in np.concatenate([u, v])}
        for _ in range(n):
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                least[a] = least[b] = min(least[a], least[b])
        nodes, roots = components.least_of(u, v)
        assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == least
