"""Assembly, placement, Voronoi cells, spectra and workflows on inputs with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motefield.functions.box import Box
from motefield.operators import assembly, dynamics, generators, neighbors, placement, signal, structure, voronoi
from motefield.plans.workflow import Workflow


def test_greedy_pairs_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(f, i, 100 + j, rng.choice([0.5, 1.0, 1.5, rng.random()])) for f in range(3) for i in range(12) for j in range(12) if rng.random() < 0.4]
    want, used = [], set()
    for f, i, j, d in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if (f, i) not in used and (f, j) not in used:
            used |= {(f, i), (f, j)}
            want.append((f, i, j, d))
    df = spark.createDataFrame(rows, "frame int, i long, j long, dist double")
    assert sorted(map(tuple, assembly.disjoint_pairs(df).select("frame", "i", "j", "dist").collect())) == sorted(want)
    assert assembly.disjoint_pairs(df.limit(0)).count() == 0
    assert [r.dist for r in assembly.disjoint_pairs(df, limit=4).collect()] == sorted(d for *_, d in want)[:4]


def test_sites_labels_and_copies(spark):
    sites = spark.createDataFrame([(m, a) for m in (1, 2) for a in range(5)], "mol int, atom long")
    assert sorted((r.mol, r.atom) for r in assembly.every_nth(sites, 2).collect()) == [(m, a) for m in (1, 2) for a in (0, 2, 4)]
    assert assembly.label_sites(sites, 3, "R").where("site = 'R'").count() == 4
    kinds = spark.createDataFrame([("10",), ("9",), ("c",), ("B",), (None,), ("9",)], "type string")
    assert [r.type for r in assembly.type_map(kinds).orderBy("id").collect()] == ["9", "10", "B", "c"]
    strand = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.5, 0.0, 0.0)], "atom long, x double, y double, z double")
    grid = assembly.replicas_grid(strand, 2, 10.0, jitter=0.5, seed=3)
    assert grid.count() == 16 and grid.agg(F.min("mol"), F.max("mol")).first() == (1, 8)
    ends = grid.where("atom = 0").join(grid.where("atom = 1").select("mol", *[F.col(c).alias(f"{c}2") for c in "xyz"]), "mol")
    lengths = ends.select(F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 + (F.col("z") - F.col("z2")) ** 2).alias("d"))
    assert lengths.agg(F.min("d"), F.max("d")).first() == pytest.approx((1.5, 1.5))
    assert sorted(grid.select(*"xyz").collect()) == sorted(assembly.replicas_grid(strand, 2, 10.0, jitter=0.5, seed=3).select(*"xyz").collect())
    assert [r.x for r in assembly.replicas_line(strand, 2, 3.0).orderBy("mol", "atom").collect()] == [0.0, 1.5, 3.0, 4.5]
    members = spark.createDataFrame([(7, 0), (8, 0), (8, 1)], "bead long, atom long")
    assert {r.atom: r.beads for r in assembly.beads_of(spark.range(3).select(F.col("id").alias("atom")), members).collect()} == {0: [7, 8], 1: [8], 2: []}


def test_constraints(spark):
    points = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 5.0, 1.0, -1.0), (2, 0.5, 0.0, 0.0)], "atom long, x double, y double, z double")
    c = placement.inside_box((2, 2, 2))
    s = placement.outside_sphere(1.0)
    assert placement.penalty(points, c).first()[0] == 1.0 and placement.penalty(points, s).first()[0] == 1.0
    assert placement.penalty(points, c & s).first()[0] == 2.0 and placement.penalty(points, c | s).first()[0] == 1.0
    moves = {r.atom: (r.gx, r.gy, r.gz) for r in placement.gradient(points, c & s).collect()}
    assert moves == {0: (0.0, 0.0, 0.0), 1: (-1.0, 0.0, 1.0), 2: (-1.0, 0.0, 0.0)}
    assert {r.atom: r.gx for r in placement.gradient(points, c | s).collect()} == {0: 0.0, 1: -0.5, 2: -0.5}
    box = Box.cubic(20.0)
    framed = points.withColumn("frame", F.lit(0))
    assert placement.min_distance_penalty(framed, 2.0, box).first().penalty == pytest.approx((2 - 1.5) ** 2)
    push = {r.atom: r for r in placement.min_distance_gradient(framed, 2.0, box).collect()}
    assert (push[0].gx, push[0].gy) == pytest.approx((2 * 0.5 * 0.5 / 1.5, 2 * 0.5 * 1 / 1.5)) and push[1].gx == 0.0


def test_voronoi_cells_fill_the_box(spark):
    rng = np.random.default_rng(2)
    box = Box.cubic(10.0)
    rows = [(f, i, *map(float, p), float(r)) for f in (0, 1) for i, (p, r) in enumerate(zip(rng.random((500, 3)) * 10, 0.3 + 0.2 * rng.random(500)))]
    atoms = spark.createDataFrame(rows, "frame int, atom long, x double, y double, z double, radius double")
    cells = voronoi.radical_cells(atoms, box, 4.9).cache()
    assert cells.where("not closed").count() == 0
    assert [r.v for r in cells.groupBy("frame").agg(F.sum("volume").alias("v")).collect()] == pytest.approx([1000.0, 1000.0], rel=1e-9)
    faces = cells.select("frame", "atom", F.explode("faces").alias("f")).select("frame", "atom", "f.*")
    back = faces.select("frame", F.col("atom").alias("neighbour"), F.col("neighbour").alias("atom"), F.col("area").alias("other"))
    both = faces.join(back, ["frame", "atom", "neighbour"], "left")
    assert both.where("other is null and area > 1e-6").count() == 0 and both.agg(F.max(F.abs(F.col("area") - F.col("other")))).first()[0] < 1e-8
    labels = atoms.select("frame", "atom", F.when(F.col("x") < 5, "a").otherwise("b").alias("label"))
    sizes = voronoi.domain_sizes(voronoi.domains(cells, labels))
    assert sizes.agg(F.sum("cells"), F.sum("volume")).first() == pytest.approx((1000, 2000.0))
    holes = voronoi.voids(cells, F.col("atom") % 10 == 0)
    assert holes.agg(F.sum("cells")).first()[0] == 100


def test_voronoi_of_a_lattice_and_its_density(spark):
    atoms = generators.build_crystal(spark, [[2.0, 0, 0], [0, 2.0, 0], [0, 0, 2.0]], generators.lattice_basis("sc"), (4, 4, 4)).select(F.lit(0).alias("frame"), "atom", "x", "y", "z", F.lit(1.0).alias("radius"), (F.col("atom") % 2).alias("mol"), F.lit(8.0).alias("nuclear"))
    box = Box.cubic(8.0)
    cells = voronoi.radical_cells(atoms, box, 3.9)
    assert cells.agg(F.min("volume"), F.max("volume"), F.min(F.size("faces")), F.max(F.size("faces"))).first() == pytest.approx((8.0, 8.0, 6, 6))
    grid = spark.range(16**3).select(F.lit(0).alias("frame"), F.col("id").alias("voxel"), *[((F.floor(F.col("id") / 16**k) % 16) * 0.5 + 0.25).alias(c) for k, c in enumerate("xyz")], F.lit(1.0).alias("density"))
    told = voronoi.integrate_density(grid, atoms, box, 2.0, 0.125)
    assert sorted(r.charge for r in told.collect()) == pytest.approx([0.0, 0.0])


def test_third_order_invariants(spark):
    cell = [[5.26, 0, 0], [0, 5.26, 0], [0, 0, 5.26]]
    atoms = generators.build_crystal(spark, cell, generators.lattice_basis("fcc"), (4, 4, 4)).withColumn("frame", F.lit(0))
    pairs = neighbors.neighbor_pairs(atoms, Box.cubic(4 * 5.26), 4.5)
    for order, value in ((4, -0.159317), (6, -0.013161)):
        low, high = structure.steinhardt(pairs, order, third=True, normalize=True).agg(F.min("w"), F.max("w")).first()
        assert (low, high) == pytest.approx((value, value), abs=1e-6)
    assert structure.wigner_3j(2, 0, 0, 0) == pytest.approx(-math.sqrt(2 / 35)) and structure.wigner_3j(1, 1, -1, 0) == pytest.approx(math.sqrt(1 / 6))


def test_spectra(spark):
    n, dt = 64, 0.5
    curve = spark.range(n).select(F.col("id").cast("int").alias("lag"), F.cos(F.col("id") * (2 * math.pi * 5 / n)).alias("acf"))
    assert signal.ir_spectrum(curve, n, dt).orderBy(F.desc("intensity")).first().k == 5
    raman = signal.raman_spectrum(curve, curve, n, dt).where("k = 5").first()
    assert raman.perpendicular / raman.parallel == pytest.approx((1 / 15) / (1 + 4 / 45))
    assert signal.roa_spectrum(curve, curve, n, dt).where("k = 5").first().intensity == pytest.approx(raman.anisotropic * 96 / 90)
    hot = signal.raman_spectrum(curve, curve, n, dt, laser=20_000.0, temperature=300.0).where("k = 5").first()
    x = hot.omega * signal.HBAR_OVER_K / 300
    assert hot.isotropic / raman.isotropic == pytest.approx((1 - hot.wavenumber / 20_000) ** 4 * x / (1 - math.exp(-x)))
    long = 5000
    wave = spark.range(long).select(F.col("id").cast("int").alias("lag"), F.cos(F.col("id") * (2 * math.pi * 40 / long)).alias("acf"))
    assert signal.power_spectrum(wave, "acf", long, dt).orderBy(F.desc("intensity")).first().k == 40


def test_dielectric_spectra_of_a_debye_process(spark):
    n, dt, tau, strength = 4000, 1.0, 40.0, 9.0
    decay = spark.range(n).select(F.col("id").cast("int").alias("lag"), (3.0 * F.exp(-F.col("id") * dt / tau)).alias("acf"))
    rows = signal.einstein_helfand_spectrum(decay, n, dt, strength).where("k between 1 and 40").collect()
    for r in rows:
        want = 1 + strength / (1 + 1j * r.omega * tau)
        assert (r.eps_real, r.eps_imag) == pytest.approx((want.real, -want.imag), abs=0.02)
    fit = signal.fit_debye(spark.createDataFrame(rows), 1.0).first()
    assert fit.tau == pytest.approx(tau, rel=0.01)
    losses = spark.range(1, 4001).select(F.col("id").cast("int").alias("k"), (F.col("id") * 0.0005).alias("omega")).withColumn("eps_imag", strength * F.col("omega") * tau / (1 + (F.col("omega") * tau) ** 2))
    real = signal.kramers_kronig(losses.where("k % 20 < 2"), 1.0)
    assert real.count() == 400
    flat = signal.plateau(decay, "acf", 0.5).first()
    assert flat.value == pytest.approx(0, abs=1e-6) and flat.n == 2000


def test_dipoles(spark):
    rows = [(k, math.sin(k / 3), math.cos(k / 5)) for k in range(50)]
    m = spark.createDataFrame(rows, "frame long, mx double, my double")
    curve = {r.lag: r for r in dynamics.debye_relaxation(m, ["mx", "my"], 5).collect()}
    x = np.array(rows)[:, 1:]
    x = x - x.mean(axis=0)
    assert curve[3].acf == pytest.approx((x[3:] * x[:-3]).sum(axis=1).mean()) and curve[0].phi == 1.0
    flow = {r.frame: r.mx for r in dynamics.current_density(m, ["mx"], 0.5, 2.0).collect()}
    assert flow[0] == pytest.approx(rows[1][1] / 0.5 / 2) and flow[10] == pytest.approx((rows[11][1] - rows[9][1]) / 1.0 / 2)


def test_workflow(spark):
    w = Workflow().add("twice", lambda df: df.withColumn("id", F.col("id") * 2), {"df": "given"}).add("both", lambda a, b: a.union(b), {"a": "twice", "b": "given"})
    assert w.outside() == {"given"} and w.order().index("twice") < w.order().index("both")
    assert sorted(r.id for r in w.run(given=spark.range(2))["both"].collect()) == [0, 0, 1, 2]
    with pytest.raises(ValueError, match="already|there"):
        w.add("both", lambda: None)
    with pytest.raises(ValueError, match="cycle"):
        Workflow().add("a", lambda x: x, {"x": "b"}).add("b", lambda x: x, {"x": "a"})
    with pytest.raises(KeyError):
        w.run()


def test_spatial_distribution_in_the_body_frame(spark):
    """A molecule that turns and drifts keeps its neighbour, and the neighbour's direction, in one voxel."""
    template = np.array([[1.0, 0, 0], [-0.5, 0.8, 0], [-0.5, -0.8, 0.3]])
    head, tail = np.array([1.2, 1.3, 0.7]), np.array([1.2, 0.3, 0.7])
    rows = []
    for f in range(5):
        q, _ = np.linalg.qr(np.random.default_rng(f).standard_normal((3, 3)))
        q *= np.sign(np.linalg.det(q))
        for a, p in enumerate([*(template - template.mean(axis=0)), head, tail]):
            rows.append((f, a, *map(float, q @ p + 3.0 * f)))
    atoms = spark.createDataFrame(rows, "frame int, atom long, x double, y double, z double")
    ways = spark.createDataFrame([(f, 3, 4) for f in range(5)], "frame int, atom long, tail long")
    cells = structure.spatial_distribution(atoms, [0, 1, 2], template, [3], Box.cubic(50.0), (4, 4, 4), (2.0, 2.0, 2.0), 0.5, ways)
    (row,) = cells.where("count > 0").collect()
    assert (row.bx, row.by, row.bz, row["count"]) == (3, 3, 2, 5) and (row.density, row.g_sdf) == pytest.approx((1.0, 2.0))
    assert (row.ux, row.uy, row.uz) == pytest.approx((0.0, 1.0, 0.0), abs=1e-9)
    with pytest.raises(ValueError):
        structure.spatial_distribution(atoms, [0, 1], template[:2], [1], Box.cubic(50.0), 4, 2.0)


def test_open_cells_are_made_anew_until_all_are_closed(spark):
    import random

    from motefield.functions.box import Box
    from motefield.operators import voronoi

    draw = random.Random(9)
    rows = [(1, i, draw.uniform(-3, 9), draw.uniform(0, 7), draw.uniform(0, 8), draw.choice([0.5, 0.9])) for i in range(25)]
    rows += [(2, 0, 1.0, 2.0, 3.0, 0.4), (3, 0, 1.0, 1.0, 1.0, 0.5), (3, 1, 4.0, 1.0, 1.0, 0.5), (3, 2, 4.0, 1.0, 1.0, 0.5), (3, 3, 4.0, None, 1.0, 0.5)]
    atoms = spark.createDataFrame(rows, "frame long, atom long, x double, y double, z double, radius double")
    box = Box.triclinic((6.0, 7.0, 8.0), (1.0, 0.5, 0.8))
    found = {}
    for cutoff in (1.5, 9.0):
        cells = voronoi.all_cells(atoms, box, cutoff).collect()
        assert all(r.closed for r in cells) and len(cells) == 29
        sums = {f: sum(r.volume for r in cells if r.frame == f) for f in (1, 2, 3)}
        assert all(abs(v - 336.0) < 1e-6 for v in sums.values())
        found[cutoff] = {(r.frame, r.atom): (round(r.volume, 6), len(r.faces)) for r in cells}
    assert found[1.5] == found[9.0]
    # of two particles in one place the first has the cell; one particle meets its own images
    assert found[1.5][3, 2][0] == 0 and found[1.5][3, 1][0] > 100 and found[1.5][2, 0][0] == 336.0
    with pytest.raises(ValueError, match="periodic"):
        voronoi.all_cells(atoms, Box.cubic(9.0, pbc=(True, True, False)), 2.0)
