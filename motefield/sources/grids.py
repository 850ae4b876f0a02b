"""Volumetric files (Gaussian cube, CHGCAR) as rows of voxels, and cube files written.

A file of values is read by many tasks: each line's values get their place by the number of
values before them, which is known from the line's rank, since the formats fill lines in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.sources.lines import ranked_lines, write_lines

BOHR = 0.529177210903


def read_cube(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(grid, atoms): grid is (file, ix, iy, iz, x, y, z, value) with places in Angstrom, atoms
    are (file, atom, atomic_number, charge, x, y, z). Coordinates of a file are in Bohr."""
    p = F.split(F.trim("value"), r"\s+")
    lines = ranked_lines(spark, path).withColumn("p", p)
    at = lambda k: F.get("p", F.lit(k)).try_cast("double")
    heads = lines.where("line between 2 and 5").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "p"))).alias("h"))
    head = heads.select("file", F.abs(F.col("h")[0]["p"][0].try_cast("long")).alias("n"), *[F.col("h")[0]["p"][k + 1].try_cast("double").alias(f"o{c}") for k, c in enumerate("xyz")], *[F.col("h")[a]["p"][0].try_cast("long").alias(f"n{a}") for a in (1, 2, 3)], *[F.col("h")[a]["p"][k + 1].try_cast("double").alias(f"v{a}{c}") for a in (1, 2, 3) for k, c in enumerate("xyz")])
    joined = lines.join(head, "file")
    atoms = joined.where("line >= 6 and line < 6 + n").select("file", (F.col("line") - 6).alias("atom"), F.get("p", F.lit(0)).try_cast("int").alias("atomic_number"), at(1).alias("charge"), *[(at(2 + k) * BOHR).alias(c) for k, c in enumerate("xyz")])
    per = F.ceil(F.col("n3") / 6)  # lines of one row along the last axis
    body = joined.where("line >= 6 + n").withColumn("_l", F.col("line") - 6 - F.col("n"))
    cells = body.select("file", "_l", *[c for c in head.columns if c != "file"], per.alias("_per"), F.posexplode(F.filter("p", lambda w: w != "")).alias("k", "w"))
    row = F.floor(F.col("_l") / F.col("_per"))
    index = {"ix": F.floor(row / F.col("n2")).try_cast("long"), "iy": (row % F.col("n2")).try_cast("long"), "iz": ((F.col("_l") % F.col("_per")) * 6 + F.col("k")).try_cast("long")}
    placed = cells.withColumns(index)
    xyz = {c: (F.col(f"o{c}") + F.col("ix") * F.col(f"v1{c}") + F.col("iy") * F.col(f"v2{c}") + F.col("iz") * F.col(f"v3{c}")) * BOHR for c in "xyz"}
    return placed.select("file", "ix", "iy", "iz", *[v.alias(c) for c, v in xyz.items()], F.col("w").try_cast("double").alias("value")), atoms


def write_cube(grid: DataFrame, atoms: DataFrame, origin, steps, shape, path: str) -> None:
    """(ix, iy, iz, value) and (atom, atomic_number, charge, x, y, z) as a cube file: ``origin``
    and the three step vectors in Angstrom. Voxels that the grid lacks are written as 0."""
    spark = grid.sparkSession
    text = ["written by Spark", "values in order of x, y, z", " ".join([str(atoms.count()), *[f"{v / BOHR:.8f}" for v in origin]])]
    text += [" ".join([str(n), *[f"{v / BOHR:.8f}" for v in step]]) for n, step in zip(shape, steps, strict=True)]
    head = spark.createDataFrame([(0, k, 0, v) for k, v in enumerate(text)], "part int, row long, k long, value string")
    placed = atoms.select(F.lit(1).alias("part"), F.col("atom").try_cast("long").alias("row"), F.lit(0).try_cast("long").alias("k"), F.concat_ws(" ", F.col("atomic_number").cast("string"), F.format_string("%.6f", F.col("charge")), *[F.format_string("%.8f", F.col(c) / BOHR) for c in "xyz"]).alias("value"))
    nx, ny, nz = shape
    every = spark.range(nx * ny * nz).select(F.floor(F.col("id") / (ny * nz)).alias("ix"), (F.floor(F.col("id") / nz) % ny).alias("iy"), (F.col("id") % nz).alias("iz"))
    full = every.join(grid.select("ix", "iy", "iz", "value"), ["ix", "iy", "iz"], "left").fillna(0.0, ["value"])
    rows = full.groupBy((F.col("ix") * ny + F.col("iy")).alias("row"), F.floor(F.col("iz") / 6).alias("k")).agg(F.array_sort(F.collect_list(F.struct("iz", "value"))).alias("v"))
    body = rows.select(F.lit(2).alias("part"), "row", "k", F.array_join(F.transform("v", lambda s: F.format_string("%.8e", s["value"])), " ").alias("value"))
    write_lines(head.union(placed).union(body), ["part", "row", "k"], path)


def read_chgcar(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(grid, atoms): grid is (file, ix, iy, iz, value) of the first set of values, divided by
    the cell's volume to a density; atoms are (file, atom, element, u, v, w) in cell fractions,
    with ``cell``. Direct coordinates are read."""
    p = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    lines = ranked_lines(spark, path).withColumn("p", p)
    heads = lines.where("line between 1 and 6").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "p"))).alias("h"))
    scale = F.col("h")[0]["p"][0].try_cast("double")
    cell = F.transform(F.slice("h", 2, 3), lambda r: F.transform(r["p"], lambda w: w.try_cast("double") * scale))
    counts = F.transform(F.col("h")[5]["p"], lambda w: w.try_cast("long"))
    head = heads.select("file", cell.alias("cell"), F.col("h")[4]["p"].alias("kinds"), counts.alias("counts")).withColumn("n", F.aggregate("counts", F.lit(0).try_cast("long"), lambda a, b: a + b))
    joined = lines.join(head, "file")
    kind = F.flatten(F.transform(F.arrays_zip("kinds", "counts"), lambda s: F.array_repeat(s["kinds"], s["counts"].try_cast("int"))))
    atoms = joined.where("line >= 8 and line < 8 + n").select("file", (F.col("line") - 8).alias("atom"), F.element_at(kind, (F.col("line") - 7).try_cast("int")).alias("element"), *[F.get("p", F.lit(k)).try_cast("double").alias(c) for k, c in enumerate("uvw")], "cell")
    shape = joined.where("line = 9 + n").select("file", *[F.get("p", F.lit(k)).try_cast("long").alias(f"n{k}") for k in range(3)])
    m = lambda i, j: F.col("cell")[i][j]
    volume = F.abs(m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0)))
    body = joined.where("line > 9 + n").join(shape, "file").select("file", (F.col("line") - 10 - F.col("n")).alias("_l"), "n0", "n1", "n2", volume.alias("_v"), F.posexplode("p").alias("k", "w"))
    place = F.col("_l") * 5 + F.col("k")
    found = body.where(place < F.col("n0") * F.col("n1") * F.col("n2"))
    return found.select("file", (place % F.col("n0")).alias("ix"), (F.floor(place / F.col("n0")) % F.col("n1")).alias("iy"), F.floor(place / (F.col("n0") * F.col("n1"))).alias("iz"), (F.col("w").try_cast("double") / F.col("_v")).alias("value")), atoms
