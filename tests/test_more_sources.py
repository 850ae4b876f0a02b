"""Writers against readers, force fields, grids and binary trajectories on small files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from motefield.sources import binary, forcefields, grids, structures, writers


def whole(folder, name, tmp_path):
    path = tmp_path / name
    path.write_text("".join(p.read_text() for p in sorted(folder.glob("part-*"))))
    return str(path)


@pytest.fixture
def atoms(spark):
    return spark.range(24).select(
        (F.col("id") % 2).cast("int").alias("frame"), (F.floor(F.col("id") / 2) + 1).alias("atom"), F.lit("CA").alias("name"), F.lit("ALA").alias("res_name"), F.lit("A").alias("chain"), F.lit(7).alias("res_id"), F.lit("C").alias("element"), F.lit("C.3").alias("type"), F.lit(0.25).alias("charge"), F.lit(6).alias("atomic_number"),
        *[(F.col("id") * k / 8).alias(c) for k, c in enumerate("xyz", 1)],
    )


def places(df, frame=0, shift=0):
    return sorted((r.id + shift, r.x, r.y, r.z) for r in df.collect())


def test_pdb_gro_mol2_xsf_round_trips(spark, atoms, tmp_path):
    want = sorted((r.atom, r.x, r.y, r.z) for r in atoms.where("frame = 0").collect())
    bonds = spark.createDataFrame([(0, 2, 1, "1"), (0, 1, 2, "1"), (0, 3, 4, "2")], "frame int, atomi long, atomj long, type string")
    writers.write_pdb(atoms, str(tmp_path / "pdb"), bonds)
    pdb = whole(tmp_path / "pdb", "a.pdb", tmp_path)
    assert places(structures.read_pdb(spark, pdb)) == want and structures.read_pdb(spark, pdb, models=True).count() == 24
    row = structures.read_pdb(spark, pdb).first()
    assert (row.name, row.res_name, row.chain, row.res_id, row.element) == ("CA", "ALA", "A", 7, "C")
    assert sorted((r.atomi, r.atomj) for r in structures.read_pdb_bonds(spark, pdb).collect()) == [(1, 2), (3, 4)]
    writers.write_gro(atoms, (10, 20, 30), str(tmp_path / "gro"))
    gro = structures.read_gro(spark, whole(tmp_path / "gro", "a.gro", tmp_path))
    assert [p[0] for p in places(gro)] == [p[0] for p in want] and max(abs(a - b) for p, q in zip(places(gro), want) for a, b in zip(p, q)) < 0.0051
    writers.write_mol2(atoms.where("frame = 0"), str(tmp_path / "mol2"), bonds)
    mol2 = whole(tmp_path / "mol2", "a.mol2", tmp_path)
    assert places(structures.read_mol2(spark, mol2)) == want and structures.read_mol2_bonds(spark, mol2).count() == 3
    cell = [[10.0, 0, 0], [0, 10, 0], [0, 0, 10]]
    writers.write_xsf(atoms.where("frame = 0"), cell, str(tmp_path / "xsf"))
    xsf = structures.read_xsf(spark, whole(tmp_path / "xsf", "a.xsf", tmp_path))
    assert sorted((r.atom + 1, r.x, r.y, r.z) for r in xsf.collect()) == want and xsf.first().cell == cell


def test_cube_round_trip_over_splits(spark, tmp_path):
    shape = (3, 4, 8)
    grid = spark.range(96).select(F.floor(F.col("id") / 32).alias("ix"), (F.floor(F.col("id") / 8) % 4).alias("iy"), (F.col("id") % 8).alias("iz"), (F.col("id") / 4).alias("value"))
    atoms = spark.createDataFrame([(0, 8, 8.0, 0.0, 0.5, 1.0), (1, 1, 1.0, 1.0, 0.0, 0.0)], "atom long, atomic_number int, charge double, x double, y double, z double")
    grids.write_cube(grid, atoms, (0, 0, 0), [(0.5, 0, 0), (0, 0.5, 0), (0, 0, 0.25)], shape, str(tmp_path / "cube"))
    path = whole(tmp_path / "cube", "a.cube", tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # many splits of one small file
    try:
        cells, back = grids.read_cube(spark, path)
        assert sorted((r.ix, r.iy, r.iz, r.value) for r in cells.collect()) == sorted(map(tuple, grid.collect()))
        assert cells.where("ix = 2 and iy = 1 and iz = 4").first().x == pytest.approx(1.0, abs=1e-6)
        assert [(r.atomic_number, r.charge) for r in back.orderBy("atom").collect()] == [(8, 8.0), (1, 1.0)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_chgcar(spark, tmp_path):
    values = [f"{v:.5E}" for v in range(12)]
    lines = ["title", "1.0", "2 0 0", "0 2 0", "0 0 3", "Na Cl", "1 2", "Direct", "0 0 0", "0.5 0 0", "0 0.5 0", "", "2 3 2"]
    lines += [" ".join(values[i : i + 5]) for i in range(0, 12, 5)] + ["augmentation occupancies 1 2", "9 9"]
    (tmp_path / "CHGCAR").write_text("\n".join(lines) + "\n")
    cells, atoms = grids.read_chgcar(spark, str(tmp_path / "CHGCAR"))
    assert {(r.ix, r.iy, r.iz): round(r.value * 12) for r in cells.collect()} == {(i, j, k): i + 2 * j + 6 * k for i in range(2) for j in range(3) for k in range(2)}
    assert [r.element for r in atoms.orderBy("atom").collect()] == ["Na", "Cl", "Cl"]


def test_dcd_and_trr(spark, tmp_path):
    xyz = np.arange(24, dtype=np.float32).reshape(2, 4, 3)
    record = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    raw = record(b"CORD" + struct.pack("<9i f 10i", 2, 100, 10, 0, 0, 0, 0, 0, 0, 0.5, 1, *[0] * 8, 24)) + record(struct.pack("<i", 1) + b" " * 80) + record(struct.pack("<i", 4))
    for frame in xyz:
        raw += record(struct.pack("<6d", 10, 90, 10, 90, 90, 10)) + b"".join(record(frame[:, k].astype("<f4").tobytes()) for k in range(3))
    (tmp_path / "a.dcd").write_bytes(raw + b"\x01")
    got = binary.read_dcd(spark, str(tmp_path / "a.dcd")).orderBy("frame", "atom").collect()
    assert [(r.frame, r.time, r.x, r.y, r.z) for r in got] == [(f, 50.0 + 5 * f, *map(float, xyz[f, a])) for f in range(2) for a in range(4)] and got[0].cell[0] == 10.0
    title = b"GMX_trn_file"
    head = lambda t: struct.pack(">3i", 1993, 13, 12) + title + struct.pack(">10i", 0, 0, 36, 0, 0, 0, 0, 48, 0, 0) + struct.pack(">3i", 4, 0, 0) + struct.pack(">2f", t, 0)
    body = b"".join(head(t) + np.eye(3).astype(">f4").tobytes() + xyz[f].astype(">f4").tobytes() for f, t in enumerate((0.0, 2.0)))
    (tmp_path / "a.trr").write_bytes(body)
    rows = binary.read_trr(spark, str(tmp_path / "a.trr")).orderBy("frame", "atom").collect()
    assert [(r.frame, r.time, r.x) for r in rows] == [(f, 2.0 * f, 10.0 * float(xyz[f, a, 0])) for f in range(2) for a in range(4)]


def test_xml_forcefield_layers(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<ForceField><AtomTypes><Type name="t1" class="C" element="C" mass="12.0"/><Type name="t2" class="H" element="H" mass="1.0"/></AtomTypes><HarmonicBondForce><Bond class1="C" class2="H" length="0.109" k="300"/></HarmonicBondForce><NonbondedForce><Atom type="t1" charge="-0.1" sigma="0.3" epsilon="0.2"/></NonbondedForce></ForceField>')
    (tmp_path / "b.xml").write_text('<ForceField><HarmonicBondForce><Bond class1="C" class2="H" length="0.11" k="310"/><Bond class1="C" class2="C" length="0.15" k="200"/></HarmonicBondForce></ForceField>')
    one, two = (forcefields.read_xml_forcefield(spark, str(tmp_path / n), layer) for layer, n in enumerate(("a.xml", "b.xml")))
    assert sorted((r.name, r["class"], r.mass) for r in one["Type"].collect()) == [("t1", "C", 12.0), ("t2", "H", 1.0)] and one["Angle"].count() == 0
    both = forcefields.overlay(one, two)
    assert sorted((r.class1, r.class2, r.k, r.layer) for r in both["Bond"].collect()) == [("C", "C", 200.0, 1), ("C", "H", 310.0, 1)]


def test_gromacs_topology(spark, tmp_path):
    (tmp_path / "a.top").write_text('#include "x.itp"\n[ defaults ]\n1 2 yes 0.5 0.5\n[ atomtypes ]\nC 12.0 0.0 A 0.3 0.4 ; carbon\n[ moleculetype ]\nMOL 3\n[ atoms ]\n1 C 1 RES C1 1 -0.1 12.0\n2 C 1 RES C2 2\n[ bonds ]\n1 2 1 0.15 200\n[ moleculetype ]\nSOL 2\n[ atoms ]\n1 OW 1 SOL OW 1 -0.8\n[ molecules ]\nMOL 4\n')
    top = forcefields.read_gromacs_topology(spark, str(tmp_path / "a.top"))
    assert sorted((r.molecule, r.nr, r.type, r.charge, r.mass) for r in top["atoms"].collect() if r.mass) == [("MOL", 1, "C", -0.1, 12.0)]
    assert sorted((r.molecule, r.nr) for r in top["atoms"].collect()) == [("MOL", 1), ("MOL", 2), ("SOL", 1)]
    assert [(r.ai, r.aj, r.funct, r.params) for r in top["bonds"].collect()] == [(1, 2, 1, ["0.15", "200"])]
    assert top["atomtypes"].first().params[0] == "C" and [(r.name, r["count"]) for r in top["molecules"].collect()] == [("MOL", 4)]


def test_amber(spark, tmp_path):
    pad = lambda words, w: "".join(f"{x:>{w}}" for x in words)
    names = "".join(f"{n:<4}" for n in ("C1", "H1", "H2"))
    text = f"%VERSION 1\n%FLAG ATOM_NAME\n%FORMAT(20a4)\n{names}\n%FLAG AMBER_ATOM_TYPE\n%FORMAT(20a4)\n{''.join(f'{n:<4}' for n in ('c3', 'h', 'h'))}\n%FLAG CHARGE\n%FORMAT(5E16.8)\n{pad(['1.82223E+01', '0.0E+00', '-1.82223E+01'], 16)}\n%FLAG MASS\n%FORMAT(5E16.8)\n{pad(['1.2E+01', '1.0E+00', '1.0E+00'], 16)}\n%FLAG ATOM_TYPE_INDEX\n%FORMAT(10I8)\n{pad([1, 2, 2], 8)}\n%FLAG BONDS_INC_HYDROGEN\n%FORMAT(10I8)\n{pad([0, 3, 1, 0, 6, 1], 8)}\n%FLAG EMPTY\n%FORMAT(10I8)\n\n"
    (tmp_path / "a.prmtop").write_text(text)
    top = forcefields.read_amber_topology(spark, str(tmp_path / "a.prmtop"))
    assert [(r.atom, r.name, r.type, round(r.charge, 6), r.mass) for r in forcefields.amber_atoms(top).orderBy("atom").collect()] == [(0, "C1", "c3", 1.0, 12.0), (1, "H1", "h", 0.0, 1.0), (2, "H2", "h", -1.0, 1.0)]
    assert sorted((r.atomi, r.atomj) for r in forcefields.amber_bonds(top).collect()) == [(0, 1), (0, 2)]
    (tmp_path / "a.inpcrd").write_text("title\n    3  0.0\n" + "".join(f"{v:12.7f}" for v in range(6)) + "\n" + "".join(f"{v:12.7f}" for v in range(6, 9)) + "\n")
    assert [(r.x, r.y, r.z) for r in forcefields.read_inpcrd(spark, str(tmp_path / "a.inpcrd")).orderBy("atom").collect()] == [(0.0, 1.0, 2.0), (3.0, 4.0, 5.0), (6.0, 7.0, 8.0)]
    (tmp_path / "a.frcmod").write_text("remark\nMASS\nc3 12.01 0.878\n\nBOND\nc3-h  300.0 1.09 comment\n\nANGLE\nh -c3-h  40.0 109.5\n\nNONBON\n  c3  1.9 0.1\n")
    assert sorted((r.section, r.types, r["values"]) for r in forcefields.read_frcmod(spark, str(tmp_path / "a.frcmod")).collect()) == [("ANGL", "h-c3-h", [40.0, 109.5]), ("BOND", "c3-h", [300.0, 1.09]), ("MASS", "c3", [12.01, 0.878]), ("NONB", "c3", [1.9, 0.1])]


def test_lammps_commands_and_csv(spark, tmp_path):
    (tmp_path / "a.ff").write_text("# field\npair_coeff 1 2 0.1 3.4 # a\nbond_coeff 1 harmonic 300 1.1\ninclude b.ff\n")
    rows = forcefields.read_lammps_forcefield(spark, str(tmp_path / "a.ff"))
    assert sorted((r.command, r.keys_, r.values_) for r in rows.toDF("file", "command", "keys_", "values_").collect()) == [("bond_coeff", ["1"], ["harmonic", "300", "1.1"]), ("pair_coeff", ["1", "2"], ["0.1", "3.4"])]
    forcefields.write_lammps_forcefield(rows, str(tmp_path / "out"))
    assert forcefields.read_lammps_forcefield(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "a.csv").write_text("id;name;age;height;active\n1;a;3;1.5;True\n2;b;4;2;False\n")
    block = forcefields.read_csv_block(spark, str(tmp_path / "a.csv"), delimiter=";")
    assert dict(block.dtypes) == {"id": "bigint", "name": "string", "age": "bigint", "height": "double", "active": "string"}
