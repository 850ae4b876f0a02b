"""Readers and writers of text formats, units and running results on small inputs."""

import pytest
from pyspark.sql import functions as F

from motefield.functions import units
from motefield.sources import structures
from motefield.streaming import running

DUMP = """ITEM: TIMESTEP
{t}
ITEM: NUMBER OF ATOMS
2
ITEM: BOX BOUNDS pp pp pp
0 10
-1 9
0 5.5
ITEM: ATOMS id type x y z
1 1 0.5 1 {t}
2 3 2.5 1e-1 x
"""


def test_lammps_dump_frames_are_records(spark, tmp_path):
    (tmp_path / "a.dump").write_text(DUMP.format(t=0) + DUMP.format(t=100))
    rows = structures.read_lammps_dump(spark, str(tmp_path)).orderBy("timestep", "id").collect()
    assert [(r.timestep, r.id, r.type, r.x, r.y, r.z) for r in rows] == [(0, 1, 1, 0.5, 1.0, 0.0), (0, 2, 3, 2.5, 0.1, None), (100, 1, 1, 0.5, 1.0, 100.0), (100, 2, 3, 2.5, 0.1, None)]
    assert (rows[0].lo, rows[0].hi) == ([0.0, -1.0, 0.0], [10.0, 9.0, 5.5])


def test_pdb_first_model_and_bonds(spark, tmp_path):
    atom = "ATOM  {:5d}  CA  ALA A{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00           C"
    text = "\n".join(["MODEL        1", atom.format(1, 7, 1.5, -2.25, 3), atom.format(2, 8, 0, 0, 0), "ENDMDL", "MODEL        2", atom.format(1, 7, 9, 9, 9), "ENDMDL", "CONECT    1    2", "CONECT    2    1", "END"])
    (tmp_path / "a.pdb").write_text(text)
    rows = structures.read_pdb(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.name, r.res_name, r.chain, r.res_id, r.x, r.y, r.z, r.element) for r in rows] == [(1, "CA", "ALA", "A", 7, 1.5, -2.25, 3.0, "C"), (2, "CA", "ALA", "A", 8, 0.0, 0.0, 0.0, "C")]
    assert structures.read_pdb(spark, str(tmp_path), models=True).count() == 3
    assert [(r.atomi, r.atomj) for r in structures.read_pdb_bonds(spark, str(tmp_path)).collect()] == [(1, 2)]


def test_gro_is_in_angstrom(spark, tmp_path):
    line = "{:5d}{:<5s}{:>5s}{:5d}{:8.3f}{:8.3f}{:8.3f}"
    (tmp_path / "a.gro").write_text("\n".join(["water", "1", line.format(1, "SOL", "OW", 1, 0.126, 1.624, 1.679), "   1.8 1.8 1.8", ""]))
    (row,) = structures.read_gro(spark, str(tmp_path)).collect()
    assert (row.res_id, row.res_name, row.name, row.vx) == (1, "SOL", "OW", None)
    assert (row.x, row.y, row.z) == pytest.approx((1.26, 16.24, 16.79))


def test_xyz_round_trip(spark, tmp_path):
    atoms = spark.range(20).select((F.col("id") % 4).alias("frame"), F.floor(F.col("id") / 4).alias("atom"), F.lit("Ar").alias("element"), *[(F.col("id") * k / 8).alias(c) for k, c in enumerate("xyz", 1)])
    structures.write_xyz(atoms, str(tmp_path / "out"))
    back = structures.read_xyz(spark, str(tmp_path / "out"))
    want = sorted((r.comment, r.atom, r.x, r.y, r.z) for r in atoms.withColumn("comment", F.concat(F.lit("frame "), F.col("frame"))).collect())
    assert sorted((r.comment, r.atom, r.x, r.y, r.z) for r in back.collect()) == want


def _xyz(sizes):
    lines = []
    for f, n in enumerate(sizes):
        # comments and atoms that look like count lines
        lines += [f" {n}", "7" if f % 2 else f"frame {f}", *[f"C{f} {k} {f}.5 -1e-1" for k in range(n)]]
    return lines


def test_xyz_frames_of_different_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(structures, "_PART", 3)
    sizes = [3, 1, 0, 5, 2, 7, 1, 1, 4]
    (tmp_path / "a.xyz").write_text("\n".join(_xyz(sizes)) + "\n\n \n")
    (tmp_path / "b.xyz").write_text("2\r\nc\r\nH 0 0 0\r\nO 1 2 3 extra\r\n")
    (tmp_path / "c.xyz").write_text("")
    rows = structures.read_xyz(spark, str(tmp_path)).collect()
    a = sorted((r.frame, r.atom, r.comment, r.element, r.x, r.y, r.z) for r in rows if r.file.endswith("a.xyz"))
    assert a == [(f, k, "7" if f % 2 else f"frame {f}", f"C{f}", float(k), f + 0.5, -0.1) for f, n in enumerate(sizes) for k in range(n)]
    assert sorted((r.frame, r.atom, r.element, r.z) for r in rows if r.file.endswith("b.xyz")) == [(0, 0, "H", 0.0), (0, 1, "O", 3.0)]
    assert len(rows) == sum(sizes) + 2


def test_xyz_in_many_splits(spark, tmp_path):
    sizes = [1 + k * 7 % 11 for k in range(200)]
    (tmp_path / "a.xyz").write_text("\n".join(_xyz(sizes)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = structures.read_xyz(spark, str(tmp_path)).groupBy("frame").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.frame: r["count"] for r in found} == dict(enumerate(sizes))


@pytest.mark.parametrize("text", ["x\nc\nH 0 0 0", "1\nc\nH 0 0 0\nH 1 1 1", "1\nc\nH 0 0 0\n\n1\nc\nH 0 0 0"])
def test_xyz_without_a_count_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.xyz").write_text(text)
    with pytest.raises(ValueError, match="number of atoms"):
        structures.read_xyz(spark, str(tmp_path))


def test_xyz_that_ends_early_and_same_size(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("\n".join(_xyz([2, 2, 2])[:-1]))
    both = [sorted(map(str, structures.read_xyz(spark, str(tmp_path), same_size=s).collect())) for s in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 5
    (tmp_path / "a.xyz").write_text("\n".join(_xyz([2, 3])))
    with pytest.raises(Exception, match="differ"):
        structures.read_xyz(spark, str(tmp_path), same_size=True).collect()


def test_units():
    assert units.factor("energy", "metal", "real") == pytest.approx(23.0605, abs=1e-3)
    assert units.factor("length/time", "real", "si") == pytest.approx(1e5)
    assert units.factor("temperature", units.reduced(6.63e-26, 3.4e-10, 1.65e-21), "si") == pytest.approx(119.5, abs=0.1)
    assert set(units.SYSTEMS) == {"real", "metal", "si", "cgs", "electron", "micro", "nano"}


def test_running_histogram_over_files(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id * 10) AS time, id % 7 AS v FROM range(60)")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = running.running_histogram(running.read_frames(spark, str(tmp_path / "in"), rows.schema, 1), "v", 3, 0.0, 6.0, window="5 hours")
    query = stream.writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = {(r.window.start, r.bin): r["count"] for r in spark.table("running").collect()}
    want = {(r.s, r.b): r.n for r in rows.where("v < 6").groupBy(F.window("time", "5 hours").start.alias("s"), F.floor(F.col("v") / 2).alias("b")).agg(F.count("*").alias("n")).collect()}
    assert found == want


def test_mol2_first_molecule(spark, tmp_path):
    one = "@<TRIPOS>MOLECULE\nm\n@<TRIPOS>ATOM\n 1 C1 0.5 1 -2 C.3 1 LIG 0.25\n 2 H1 0 0 0 H\n@<TRIPOS>BOND\n 1 1 2 ar\n"
    (tmp_path / "a.mol2").write_text(one + one)
    (tmp_path / "b.mol2").write_text("")
    rows = structures.read_mol2(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, "C1", 0.5, 1.0, -2.0, "C.3", 1, "LIG", 0.25), (2, "H1", 0.0, 0.0, 0.0, "H", None, None, None)]
    assert [tuple(r)[1:] for r in structures.read_mol2_bonds(spark, str(tmp_path)).collect()] == [(1, 2, "ar")]


def test_xsf_cell_and_atoms(spark, tmp_path):
    (tmp_path / "a.xsf").write_text("CRYSTAL\nPRIMVEC\n 4 0 0\n 0 5 0\n 0 0 6\nPRIMCOORD\n2 1\n 8 0 0 0.5\n 1 1 2 3\n")
    rows = structures.read_xsf(spark, str(tmp_path)).orderBy("atom").collect()
    assert [tuple(r)[2:] for r in rows] == [(0, 8, 0.0, 0.0, 0.5), (1, 1, 1.0, 2.0, 3.0)]
    assert rows[0].cell == [[4.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 6.0]]
