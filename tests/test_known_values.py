"""Operators on inputs whose results are known in closed form."""

import math
import random

import pytest
from pyspark.sql import functions as F

from motefield.functions import geometry
from motefield.functions.box import Box
from motefield.operators import components, forcefield, generators, graph, neighbors, shape, signal, structure, trajectory


@pytest.fixture(scope="module")
def crystal(spark):
    cell = [[5.26, 0, 0], [0, 5.26, 0], [0, 0, 5.26]]
    atoms = generators.build_crystal(spark, cell, generators.lattice_basis("fcc"), (4, 4, 4)).withColumn("frame", F.lit(0))
    box = Box.cubic(4 * 5.26)
    return atoms, box, neighbors.neighbor_pairs(atoms, box, 4.5)


def test_fcc_neighbours_and_order(crystal):
    atoms, box, pairs = crystal
    assert atoms.count() == 256 and pairs.count() == 256 * 12 // 2
    assert pairs.agg(F.max("dist") - F.min("dist")).first()[0] < 1e-9
    for order, value in ((4, 0.190940653956493), (6, 0.574524259714070)):
        low, high = structure.steinhardt(pairs, order).agg(F.min("q"), F.max("q")).first()
        assert (low, high) == pytest.approx((value, value), abs=1e-9)
    solid = structure.solid_liquid(pairs, 6)
    assert solid.where("is_solid and n_solid_bonds = 12").count() == 256


def test_free_box_has_no_rdf(crystal):
    atoms, _, pairs = crystal
    with pytest.raises(ValueError):
        structure.rdf(pairs, atoms, Box(((0.0,) * 3,) * 3), 10, 4.0)


def test_clusters_of_a_crystal_are_one(crystal):
    atoms, _, pairs = crystal
    assert [(r.cluster, r.size) for r in shape.cluster_sizes(shape.clusters(pairs, atoms)).collect()] == [(0, 256)]


def test_components_of_a_path_and_nothing(spark):
    path = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert components.connected_components(path).groupBy("component").count().collect() == [(0, 201)]
    assert components.connected_components(path.limit(0)).count() == 0


def test_triclinic_cell_from_angles():
    box = Box.from_lengths_angles((3, 4, 5), (80, 95, 100))
    assert box.angles == pytest.approx((80, 95, 100)) and box.lengths == pytest.approx((3, 4, 5))


def test_dihedral_and_rotation(spark):
    row = spark.range(1).select(geometry.dihedral(*[[F.lit(float(v)) for v in b] for b in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]).alias("d")).first()
    assert abs(row.d) == pytest.approx(math.pi / 2)
    assert geometry.rotation_matrix((0, 0, 2), 90) @ [1, 0, 0] == pytest.approx([0, 1, 0], abs=1e-12)


def test_paths_of_a_chain(spark):
    bonds = spark.range(999).select(F.col("id").alias("atomi"), (F.col("id") + 1).alias("atomj"))
    assert graph.angles(bonds).count() == 998 and graph.dihedrals(bonds).count() == 997


def test_time_splits(spark):
    rows = spark.range(10).select(F.col("id").cast("int").alias("frame"), (F.col("id") * 0.5).alias("time"), F.lit(0).alias("particle"))
    found = trajectory.split_by_time(rows, 1.0, ["particle"]).orderBy("frame").collect()
    assert [r.segment for r in found] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_lennard_jones_minimum(spark):
    row = spark.range(1).select(forcefield.lennard_jones(F.lit(2 ** (1 / 6)), F.lit(0.3), F.lit(1.0)).alias("e")).first()
    assert row.e == pytest.approx(-0.3)


def test_windows_are_zero_at_both_ends(spark):
    for kind in ("hann", "blackman"):
        w = [r.v for r in signal.apply_window(spark.range(9).select(F.col("id").alias("frame"), F.lit(1.0).alias("v")), "v", kind, 9).orderBy("frame").collect()]
        assert (w[0], w[4], w[8]) == pytest.approx((0, 1, 0), abs=1e-12)
    with pytest.raises(ValueError):
        signal.window_weight("none", F.lit(0), 3)


def test_spectrum_peaks_where_the_curve_turns(spark):
    curve = spark.range(64).select(F.col("id").cast("int").alias("lag"), F.cos(F.col("id") * (2 * math.pi * 10 / 64)).alias("acf"))
    top = signal.power_spectrum(curve, "acf", 64, 0.5).orderBy(F.desc("intensity")).first()
    assert top.k == 10 and top.omega == pytest.approx(2 * math.pi * 10 / 32)


def test_debye_fit_of_a_debye_spectrum(spark):
    omega, tau, step = F.col("omega"), 8.5, 70.0
    rows = spark.range(1, 400).select((F.col("id") * 0.001).alias("omega")).select("omega", (2 + step / (1 + (omega * tau) ** 2)).alias("eps_real"), (step * omega * tau / (1 + (omega * tau) ** 2)).alias("eps_imag"))
    assert signal.fit_debye(rows, 2.0).first().tau == pytest.approx(tau)


def test_triplets_of_every_form():
    r, t = generators.parse_triplet("-y+1/2, 2x - z, z + .25" .replace(".25", "0.25"))
    assert r.tolist() == [[0, -1, 0], [2, 0, -1], [0, 0, 1]] and [float(v) for v in t] == [0.5, 0.0, 0.25]
    for bad in ("x,y", "x,y,z,x", "x,,z", "x,y,w", "x,y,z/"):
        with pytest.raises(ValueError):
            generators.parse_triplet(bad)


def test_moments_far_from_the_origin(spark):
    rows = spark.range(50).select(F.lit(0).alias("g"), *[(F.lit(1e7) + F.col("id") * k / 8).alias(c) for k, c in enumerate("xyz", 1)])
    near = rows.select("g", *[(F.col(c) - 1e7).alias(c) for c in "xyz"])
    for mass in (None, F.lit(2.0) + F.col("x") - F.col("x")):
        far, close = (shape.moments(df, ["g"], mass).first() for df in (rows, near))
        assert (far.gxx, far.ixy, far.rg) == pytest.approx((close.gxx, close.ixy, close.rg), rel=1e-6)


@pytest.mark.parametrize("lengths", [(9.0, 5.0, 4.2), (4.1, 4.1, 4.1), (30.0, 4.5, 9.0)])
def test_pairs_of_thin_boxes_against_all_pairs(spark, lengths):
    """Axes of one, two and more cells."""
    rng = random.Random(str(lengths))
    points = [tuple(rng.random() * n for n in lengths) for _ in range(60)]
    df = spark.createDataFrame([(0, i, *p) for i, p in enumerate(points)], "frame int, atom long, x double, y double, z double")
    gap = lambda a, b: math.sqrt(sum((d - n * round(d / n)) ** 2 for d, n in ((q - p, n) for p, q, n in zip(a, b, lengths))))
    want = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if gap(points[i], points[j]) <= 2.0)
    assert sorted((r.i, r.j) for r in neighbors.neighbor_pairs(df, Box.orthogonal(*lengths), 2.0).collect()) == want


@pytest.mark.parametrize("kind", ["random", "chain", "hub", "pairs"])
def test_components_against_union_find(spark, kind):
    rng = random.Random(kind)
    edges = {
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, 7), (900, 900), (None, 3)],
        "chain": [(i, i + 1) for i in rng.sample(range(300), 300)],
        "hub": [(5_000, i) for i in range(500)] + [(6_000, 5_000), (6_000, 9_000)],
        "pairs": [(2 * i, 2 * i + 1) for i in range(50)] * 2,
    }[kind]
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        if a is not None:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    assert {(r.node, r.component) for r in components.connected_components(df).collect()} == {(i, find(i)) for i in list(root)}


def test_kmeans_labels_are_a_fixed_point(spark):
    import numpy as np

    from motefield.plans import catalogue

    found = dict(map(tuple, catalogue.QUERIES["kmeans"](spark, "/root/testdata/sf0.001").collect()))
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding[:8] for r in rows], dtype=float)
    label = np.array([found[r.vec_id] for r in rows])
    centers = np.array([x[label == k].mean(axis=0) for k in range(10)])
    away = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    # each row is nearest to the mean of its own rows
    assert (away[np.arange(len(x)), label] <= away.min(axis=1) + 1e-9).all()


def test_components_of_pca_are_the_axes_of_most_variance(spark):
    import numpy as np

    from motefield.plans import catalogue

    found = {r.vec_id: (r.pc1, r.pc2) for r in catalogue.QUERIES["pca"](spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding[:8] for r in rows], dtype=float)
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (x - x.mean(axis=0)) @ axes[:2].T
    got = np.array([found[r.vec_id] for r in rows])
    for k in range(2):
        assert np.allclose(got[:, k], want[:, k], atol=1e-6) or np.allclose(got[:, k], -want[:, k], atol=1e-6)


def test_chain_masses_have_the_moments_of_their_distribution(spark):
    from motefield.operators import generators

    rows = generators.sample_chains(spark, 40_000, lambda rng, n: rng.gamma(2.0, 500.0, n), seed=7).toPandas()
    assert len(rows) == 40_000 and rows["chain"].is_unique
    mn, mw = rows["value"].mean(), (rows["value"] ** 2).sum() / rows["value"].sum()
    assert abs(mn - 1000) < 15 and abs(mw - 1500) < 30  # the errors expected are 3.5 and 6
