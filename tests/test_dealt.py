"""What is dealt to tasks: atoms, not the voxels they reach, and many small groups a task."""

import numpy as np

from motefield.functions.box import Box
from motefield.operators import forcefield, structure


def test_voxels_are_summed_where_their_atoms_are(spark):
    """Voxels were shuffled, for each atom all that it reaches."""
    atoms = spark.range(60).selectExpr("id % 2 AS frame", "id AS atom", "rand(1) * 50 AS x", "rand(2) * 11 AS y", "rand(3) * 9 AS z")
    found = structure.gaussian_density(atoms, Box.orthogonal(50.0, 11.0, 9.0), (10, 11, 9), 1.1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("HashAggregate") < plan.index("Exchange")


def test_groups_are_no_calls_of_their_own(spark):
    """Each pair of blocks, and each frame to fit, was a call with a table of its own."""
    rows = [(f, a, float(a % 5), float(a // 5 % 5), float(a * f % 3)) for f in range(4) for a in range(30 if f else 1)]
    atoms = spark.createDataFrame(rows, "frame int, atom long, x double, y double, z double")
    found = structure.structure_factor(atoms, [0.0, 0.7], block=8)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.frame, r.k): r.s for r in found.collect()}
    for f in range(4):
        x = np.array([r[2:] for r in rows if r[0] == f])
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        for k in (0.0, 0.7):
            assert abs(got[f, k] - np.sinc(k * d / np.pi).sum() / len(x)) < 1e-9
    turned = structure.spatial_distribution(atoms, [0, 1, 2], [[0.0, 0, 0], [1.0, 0, 0], [0, 1.0, 0]], list(range(3, 30)), Box.cubic(20.0), 2, 9.0)
    assert "FlatMapGroups" not in turned._jdf.queryExecution().executedPlan().toString() and turned.agg({"count": "sum"}).first()[0] == 81


def test_terms_are_neither_sorted_nor_shuffled(spark):
    """The keys of all terms of a file were sorted in the one task that read it."""
    terms = spark.range(0, 3000, 1, 1).selectExpr("id AS term", "concat('t', id % 4) AS a", "if(id % 5 = 0, null, concat('t', id % 3)) AS b")
    classes = spark.createDataFrame([("t0", "c"), ("t1", "c"), ("t2", "d"), ("t3", "d")], "type string, class string")
    patterns = spark.createDataFrame([("wide", ["*", "*"], 0, 1), ("both", ["c", "d"], 1, None), ("late", ["c", "d"], 1, 3), ("exact", ["t1", "t1"], 0, 3)], "name string, comp array<string>, layer int, ord int")
    found = forcefield.match_terms(terms, ["a", "b"], classes, patterns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "hashpartitioning" not in plan

    def best(a, b):
        if b is None:
            return None, None
        if a == b == "t1":
            return "exact", 6
        return ("late", 2) if (a in ("t0", "t1")) != (b in ("t0", "t1")) else ("wide", 0)

    assert all((r.name, r.score) == best(r.a, r.b) for r in found.collect()) and found.count() == 3000
