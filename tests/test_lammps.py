"""LAMMPS files written and read back, and read from texts as the program writes them."""

import pytest
from pyspark.sql import functions as F

from motefield.sources import lammps, structures

DATA = """A box of two

4 atoms
2 atom types
1 bonds
1 bond types

-1.0 9.0 xlo xhi
0 10 ylo yhi   # with a comment
0.5 10.5 zlo zhi
1 0 0 xy xz yz

Masses

1 12.011 # C
2 1.008

Bond Coeffs # harmonic

1 300.0 1.09

Atoms # full

2 1 2 0.25 1 2 3 0 0 -1
1 1 1 -0.25 0.5 0.5 0.5 0 0 0

3 2 1 0 4 4 4 # no flags
4 2 2 0 5 5 5 1 0 0

Velocities

1 0.1 0.2 0.3

Bonds

1 1 1 2
"""


def test_data_file(spark, tmp_path):
    (tmp_path / "a.data").write_text(DATA)
    held = lammps.read_lammps_data(spark, str(tmp_path / "a.data"))
    head = held.header.first()
    assert head.title == "A box of two" and head.counts == {"atoms": 4, "atom types": 2, "bonds": 1, "bond types": 1}
    assert (head.lo, head.hi, head.tilt) == ([-1.0, 0.0, 0.5], [9.0, 10.0, 10.5], [1.0, 0.0, 0.0])
    atoms = held.atoms.orderBy("id").collect()
    assert [(r.id, r.mol, r.type, r.charge, r.x, r.iz, r.vx) for r in atoms] == [(1, 1, "1", -0.25, 0.5, 0, 0.1), (2, 1, "2", 0.25, 1.0, -1, None), (3, 2, "1", 0.0, 4.0, None, None), (4, 2, "2", 0.0, 5.0, 0, None)]
    assert [(r.type, r.mass) for r in held.masses.orderBy("type").collect()] == [("1", 12.011), ("2", 1.008)]
    assert [(r.section, r.key, r["values"]) for r in held.coeffs.collect()] == [("Bond Coeffs", "1", ["300.0", "1.09"])]
    assert [(r.id, r.type, r.atomi, r.atomj) for r in held.links["Bonds"].collect()] == [(1, "1", 1, 2)]
    assert held.links["Angles"].count() == 0 and held.labels.count() == 0


def test_data_file_without_an_axis_and_with_another_style(spark, tmp_path):
    (tmp_path / "b.data").write_text("t\n\n1 atoms\n0 1 xlo xhi\n0 1 ylo yhi\n\nAtoms # atomic\n\n1 C 0 0 0\n")
    held = lammps.read_lammps_data(spark, str(tmp_path / "b.data"))
    assert [(r.id, r.type, r.x) for r in held.atoms.collect()] == [(1, "C", 0.0)]
    with pytest.raises(Exception, match="box axis"):
        held.header.collect()
    with pytest.raises(ValueError):
        lammps.read_lammps_data(spark, str(tmp_path / "b.data"), "peri")


def test_data_round_trip(spark, tmp_path):
    atoms = spark.range(1, 301).select("id", (F.col("id") % 7).alias("mol"), (F.col("id") % 3 + 1).cast("string").alias("type"), (F.col("id") / 8 - 1).alias("charge"), *[(F.col("id") * k / 16).alias(c) for k, c in enumerate("xyz", 1)]).repartition(5)
    bonds = spark.range(1, 300).select("id", F.lit("1").alias("type"), F.col("id").alias("atomi"), (F.col("id") + 1).alias("atomj"))
    masses = spark.createDataFrame([("1", 12.0), ("2", 1.0), ("3", 16.5)], "type string, mass double")
    coeffs = spark.createDataFrame([("Bond Coeffs", "1", ["10", "1.5"])], "section string, key string, values array<string>")
    lammps.write_lammps_data(str(tmp_path / "parts"), atoms, (0, 0, 0), (20, 40, 60), masses, {"Bonds": bonds}, coeffs)
    whole = "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))
    (tmp_path / "one.data").write_text(whole)
    back = lammps.read_lammps_data(spark, str(tmp_path / "one.data"))
    columns = ["id", "mol", "type", "charge", "x", "y", "z"]
    assert sorted(map(tuple, back.atoms.select(*columns).collect())) == sorted(map(tuple, atoms.select(*columns).collect()))
    assert sorted(map(tuple, back.links["Bonds"].select("id", "type", "atomi", "atomj").collect())) == sorted(map(tuple, bonds.collect()))
    assert back.header.first().counts == {"atoms": 300, "atom types": 3, "bonds": 299, "bond types": 1} and back.masses.count() == 3 and back.coeffs.count() == 1


def test_dump_round_trip_and_columns_by_header(spark, tmp_path):
    atoms = spark.range(40).select((F.col("id") % 4 * 10).alias("frame"), (F.floor(F.col("id") / 4) + 1).alias("id"), F.lit(2).alias("type"), *[(F.col("id") * k / 8).alias(c) for k, c in enumerate("xyz", 1)])
    lammps.write_lammps_dump(atoms, (0, 0, 0), (5, 6, 7), str(tmp_path / "parts"))
    (tmp_path / "a.dump").write_text("".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*"))))
    (tmp_path / "b.dump").write_text("ITEM: TIMESTEP\n7\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS pp pp pp\n0 1\n0 1\n0 1\nITEM: ATOMS z q id x\n3.5 -1 9 1.5\n")
    back = structures.read_lammps_dump(spark, [str(tmp_path / "a.dump"), str(tmp_path / "b.dump")])
    got = sorted((r.timestep, r.id, r.x, r.y, r.z) for r in back.where("timestep <> 7").collect())
    assert got == sorted((r.frame, r.id, r.x, r.y, r.z) for r in atoms.collect())
    row = back.where("timestep = 7").first()
    assert (row.id, row.x, row.y, row.z, row.q, row.type) == (9, 1.5, None, 3.5, -1.0, None)


LOG = """LAMMPS (2 Aug 2023)
WARNING: something odd (src/x.cpp:1)
Per MPI rank memory allocation (min/avg/max) = 3 | 3 | 3 Mbytes
   Step          Temp          E_pair
         0   1.5           -6.25
WARNING: in between
       100   1.25          -5.5
Loop time of 0.5 on 4 procs for 100 steps with 32 atoms

Step PotEng Volume Press
100 -5.5 10 0.1
150 -5.0 10 0.2
200 -4.5 10 -nan
Loop time of 0.25 on 4 procs for 100 steps with 32 atoms
Total wall time: 0:00:01
"""


def test_log_of_two_runs(spark, tmp_path):
    (tmp_path / "log.lammps").write_text(LOG)
    rows = lammps.read_lammps_log(spark, str(tmp_path / "log.lammps")).orderBy("run", "row").collect()
    assert [(r.run, r.row, r.thermo["Step"]) for r in rows] == [(0, 0, 0.0), (0, 1, 100.0), (1, 0, 100.0), (1, 1, 150.0)]
    assert rows[0].thermo == {"Step": 0.0, "Temp": 1.5, "E_pair": -6.25} and rows[2].thermo["PotEng"] == -5.5
    runs = lammps.read_lammps_log_runs(spark, str(tmp_path / "log.lammps")).orderBy("run").collect()
    assert [(r.run, r.seconds, r.procs, r.steps, r.atoms) for r in runs] == [(0, 0.5, 4, 100, 32), (1, 0.25, 4, 100, 32)]
    assert lammps.read_lammps_log_warnings(spark, str(tmp_path / "log.lammps")).count() == 2


def test_molecule_template(spark, tmp_path):
    (tmp_path / "m.mol").write_text("water\n\n3 atoms\n2 bonds\n\nCoords\n\n1 0 0 0\n2 1 0 0\n3 0 1 0\n\nTypes\n\n1 1\n2 2\n3 2\n\nBonds\n\n1 1 1 2\n2 1 1 3\n")
    held = lammps.read_lammps_molecule(spark, str(tmp_path / "m.mol"))
    assert [(r.id, r.x, r.type, r.charge) for r in held.atoms.orderBy("id").collect()] == [(1, 0.0, "1", None), (2, 1.0, "2", None), (3, 0.0, "2", None)]
    assert held.header.first().title == "water" and held.links["Bonds"].count() == 2
