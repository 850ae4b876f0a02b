"""Sites as rows: what atoms and their sites are together, and which atoms have none."""

import math

import pytest

from motefield.operators.virtual_sites import bisector_sites, drude_particles


def test_shells_take_charge_and_mass_from_their_atoms(spark):
    rows = [(0, 0, "CT", "C", 0.3, 12.0, 1.0, 2.0, 3.0, 7), (0, 1, "HC", "H", 0.1, 1.0, 2.0, 2.0, 3.0, 7), (1, 0, "CT", "C", 0.3, None, 4.0, 5.0, 6.0, 8), (1, 4, None, "O", -0.5, 16.0, 0.0, 0.0, 0.0, 8)]
    atoms = spark.createDataFrame(rows, "frame int, atom long, type string, element string, charge double, mass double, x double, y double, z double, mol int")
    kinds = spark.createDataFrame([("CT", 1.0, 4184.0, 0.4, 1), ("HC", 0.0, 0.0, 0.4, 1), ("XX", 1.0, 1.0, 0.1, -1)], "type string, alpha double, spring double, shell_mass double, sign int")
    found, springs = drude_particles(atoms, kinds)
    assert found.columns == atoms.columns
    got = {(r.frame, r.atom): r for r in found.collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0), (1, 4), (0, 5), (1, 5)}
    q = math.sqrt(4184.0 / 1389.35458)
    shell, core = got[0, 5], got[0, 0]
    assert (shell.type, shell.element, shell.mass, shell.mol, shell.x, shell.y, shell.z) == ("DCT", "D", 0.4, 7, 1.0, 2.0, 3.0)
    assert shell.charge == pytest.approx(q) and core.charge == pytest.approx(0.3 - q) and core.mass == pytest.approx(11.6)
    assert got[1, 0].mass is None and got[1, 5].mass == 0.4 and got[0, 1].charge == 0.1 and got[1, 4].charge == -0.5
    assert {tuple(r) for r in springs.collect()} == {(0, 0, 5, "DRUDE", 1000.0, 0.0), (1, 0, 5, "DRUDE", 1000.0, 0.0)}
    # without a sign a shell is negative
    negative, _ = drude_particles(atoms, kinds.drop("sign"))
    assert negative.where("type = 'DCT'").first().charge == pytest.approx(-q)
    none, bare = drude_particles(atoms.limit(0), kinds)
    assert none.count() == 0 and bare.count() == 0


def test_bisector_sites(spark):
    water = [(0, "O", -0.8, 0.0, 0.0, 0.0), (1, "H", 0.4, 1.0, 1.0, 0.0), (2, "H", 0.4, -1.0, 1.0, 0.0)]
    others = [(3, "O", -0.6, 5.0, 5.0, 5.0), (4, "H", 0.6, 6.0, 5.0, 5.0), (5, "O", -0.2, 0.0, 0.0, 9.0), (6, "H", 0.1, 1.0, 0.0, 9.0), (7, "H", 0.1, -1.0, 0.0, 9.0), (8, "C", 0.0, 7.0, 7.0, 7.0)]
    atoms = spark.createDataFrame([(f, *r) for f in (0, 1) for r in water + others], "frame int, atom long, element string, charge double, x double, y double, z double")
    links = [(0, 1), (2, 0), (0, 2), (3, 4), (3, 8), (5, 6), (7, 5), (5, 5)]
    bonds = spark.createDataFrame([(f, *b) for f in (0, 1) for b in links], "frame int, atomi long, atomj long")
    found, sites = bisector_sites(atoms, bonds, 0.15)
    got = {(r.frame, r.atom): r for r in found.collect()}
    assert len(got) == 18 + 4 and found.columns == atoms.columns
    for f in (0, 1):
        m = got[f, 9]
        assert (m.element, m.charge, m.x, m.z) == ("M", -0.8, 0.0, 0.0) and m.y == pytest.approx(0.15)
        assert got[f, 0].charge == 0.0 and got[f, 3].charge == -0.6
        assert (got[f, 14].x, got[f, 14].y, got[f, 14].z) == (0.0, 0.0, 9.0)  # the bonds cancel
    assert {tuple(r) for r in sites.collect()} == {(0, 0, 9), (1, 0, 9), (0, 5, 14), (1, 5, 14)}
    assert sum(r.charge for r in got.values()) == pytest.approx(sum(r.charge for r in atoms.collect()))
