"""Data files, dumps and logs of LAMMPS.

A data file is a header of counts and box axes and then sections; each section is a DataFrame
whose rows come from lines that many tasks read. What follows ``#`` is a comment, but for the
style behind ``Atoms``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motefield.sources.lines import fields, in_sections, numbered_lines, write_lines

#: The columns of an atom line by style, image flags may follow.
STYLES = {
    "atomic": ["id", "type", "x", "y", "z"],
    "charge": ["id", "type", "charge", "x", "y", "z"],
    "molecular": ["id", "mol", "type", "x", "y", "z"],
    "bond": ["id", "mol", "type", "x", "y", "z"],
    "angle": ["id", "mol", "type", "x", "y", "z"],
    "full": ["id", "mol", "type", "charge", "x", "y", "z"],
}
#: Sections of links and their numbers of ends.
LINKS = {"Bonds": 2, "Angles": 3, "Dihedrals": 4, "Impropers": 4}
#: Other sections that are read.
COEFFS = ["Pair Coeffs", "PairIJ Coeffs", "Bond Coeffs", "Angle Coeffs", "Dihedral Coeffs", "Improper Coeffs"]
LABELS = ["Atom Type Labels", "Bond Type Labels", "Angle Type Labels", "Dihedral Type Labels", "Improper Type Labels"]
OTHERS = ["Atoms", "Velocities", "Masses", *COEFFS, *LABELS]
ENDS = ["atomi", "atomj", "atomk", "atoml"]


@dataclass
class LammpsData:
    """``header``: (file, title, counts, lo, hi, tilt); ``atoms`` with velocities; ``links`` by
    section: (file, id, type, atomi, ...); ``masses``: (file, type, mass); ``coeffs``: (file,
    section, key, values); ``labels``: (file, section, id, label)."""

    header: DataFrame
    atoms: DataFrame
    masses: DataFrame
    coeffs: DataFrame
    labels: DataFrame
    links: dict[str, DataFrame] = field(default_factory=dict)


def _heading(value: Column) -> Column:
    names = "|".join(sorted([*OTHERS, *LINKS], key=len, reverse=True))
    found = F.regexp_extract(value, rf"^\s*({names})\s*(#.*)?$", 1)
    return F.nullif(found, F.lit(""))


def read_lammps_data(spark: SparkSession, path, atom_style: str | None = None) -> LammpsData:
    """The sections of data files. The style is ``atom_style``, else the comment behind
    ``Atoms``, else full. A file without all three box axes is an error when its header is read.
    Atom types may be labels; a section that a file lacks has no rows."""
    lines = numbered_lines(spark, path)
    told = in_sections(lines, _heading(F.col("value")))
    style = told.where("section = 'Atoms' and at = opens").select(F.regexp_extract("value", r"#\s*(\w+)", 1).alias("s")).where("s <> ''").first() if atom_style is None else None
    atom_style = atom_style or (style.s if style else "full")
    if atom_style not in STYLES:
        raise ValueError(f"no columns are known for the atom style {atom_style}")
    body = told.where("section is not null and at <> opens").withColumn("p", fields(F.col("value"))).where(F.size("p") > 0)
    part = lambda name: body.where(F.col("section") == name)
    at = lambda k, kind: F.get("p", F.lit(k)).try_cast(kind)
    kinds = {"id": "long", "mol": "long", "type": "string"}
    columns = STYLES[atom_style]
    flags = [at(len(columns) + k, "long").alias(n) for k, n in enumerate(("ix", "iy", "iz"))]
    atoms = part("Atoms").select("file", *[at(k, kinds.get(c, "double")).alias(c) for k, c in enumerate(columns)], *flags)
    velocities = part("Velocities").select("file", at(0, "long").alias("id"), *[at(1 + k, "double").alias(c) for k, c in enumerate(("vx", "vy", "vz"))])
    held = LammpsData(
        header=_header(told, lines), atoms=atoms.join(velocities, ["file", "id"], "left"),
        masses=part("Masses").select("file", at(0, "string").alias("type"), at(1, "double").alias("mass")),
        coeffs=body.where(F.col("section").isin(COEFFS)).select("file", "section", at(0, "string").alias("key"), F.slice("p", 2, F.size("p")).alias("values")),
        labels=body.where(F.col("section").isin(LABELS)).select("file", "section", at(0, "long").alias("id"), at(1, "string").alias("label")),
    )
    for name, n in LINKS.items():
        held.links[name] = part(name).select("file", at(0, "long").alias("id"), at(1, "string").alias("type"), *[at(2 + k, "long").alias(e) for k, e in enumerate(ENDS[:n])])
    return held


def _header(told: DataFrame, lines: DataFrame) -> DataFrame:
    """One row a file, from the lines before its first section."""
    p, value = F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+"), F.col("value")
    head = told.where("section is null").withColumn("p", p)
    counts = head.where(value.rlike(r"^\s*\d+\s+[a-z]")).select("file", F.array_join(F.slice("p", 2, F.size("p")), " ").alias("what"), F.col("p")[0].cast("long").alias("n"))
    axis = head.where(value.rlike(r"\b[xyz]lo\s+[xyz]hi\b")).select("file", F.substring(F.col("p")[2], 1, 1).alias("axis"), F.col("p")[0].cast("double").alias("lo"), F.col("p")[1].cast("double").alias("hi"))
    tilt = head.where(value.rlike(r"\bxy\s+xz\s+yz\b")).select("file", F.transform(F.slice("p", 1, 3), lambda v: v.cast("double")).alias("tilt"))
    boxes = axis.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("axis", "lo", "hi"))).alias("b"))
    title = lines.groupBy("file").agg(F.min_by("value", "at").alias("title"))
    whole = F.when(F.size(F.coalesce("b", F.array())) == 3, F.col("b")).otherwise(F.raise_error(F.concat(F.lit("a box axis is missing in "), "file")).cast("array<struct<axis:string,lo:double,hi:double>>"))
    return (
        title.join(counts.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("what", "n"))).alias("counts")), "file", "left")
        .join(boxes, "file", "left").join(tilt, "file", "left").withColumn("b", whole)
        .select("file", "title", "counts", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"), "tilt")
    )


def write_lammps_data(path: str, atoms: DataFrame, lo, hi, masses: DataFrame | None = None, links: dict[str, DataFrame] | None = None, coeffs: DataFrame | None = None, tilt=None, atom_style: str = "full", title: str = "written by Spark") -> None:
    """Text files that, one behind the other by name, are a data file.

    ``atoms`` has the columns of its style, and vx, vy, vz where velocities are to be written;
    ``links`` by section as ``read_lammps_data`` gives them; ``coeffs``: (section, key, values).
    Atom and link types may be labels; they are written as they are."""
    spark, columns, links = atoms.sparkSession, STYLES[atom_style], links or {}
    kinds = atoms.select("type").distinct()
    counts = {"atoms": atoms.count(), "atom types": (masses if masses is not None else kinds).count()}
    for name, table in links.items():
        row = table.agg(F.count("*").alias("n"), F.countDistinct("type").alias("t")).first()
        counts |= {name.lower(): row.n, f"{name[:-1].lower()} types": row.t}
    head = [title, "", *[f"{n} {what}" for what, n in counts.items()], ""]
    head += [f"{float(a)!r} {float(b)!r} {c}lo {c}hi" for a, b, c in zip(lo, hi, "xyz", strict=True)]
    head += [" ".join(repr(float(t)) for t in tilt) + " xy xz yz"] if tilt is not None else []
    text = [(0, k, v) for k, v in enumerate(head)]
    number = {"charge", "x", "y", "z", "vx", "vy", "vz"}
    word = lambda c: F.col(c).cast("double").cast("string") if c in number else F.col(c).cast("string")
    parts = []

    def add(section: str, table: DataFrame, key: Column, value: Column) -> None:
        rank = len(parts) + 1
        text.extend([(rank, -3, ""), (rank, -2, section), (rank, -1, "")])
        parts.append(table.select(F.lit(rank).alias("part"), key.cast("long").alias("row"), value.alias("value")))

    if masses is not None:
        add("Masses", masses, F.coalesce(F.col("type").try_cast("long"), F.xxhash64("type").bitwiseAND(F.lit((1 << 62) - 1))), F.concat_ws(" ", F.col("type").cast("string"), F.col("mass").cast("double").cast("string")))
    if coeffs is not None:
        for section in [s for s in COEFFS if not coeffs.where(F.col("section") == s).isEmpty()]:
            own = coeffs.where(F.col("section") == section)
            add(section, own, F.coalesce(F.col("key").try_cast("long"), F.xxhash64("key").bitwiseAND(F.lit((1 << 62) - 1))), F.concat_ws(" ", "key", F.array_join("values", " ")))
    images = [c for c in ("ix", "iy", "iz") if c in atoms.columns]
    add(f"Atoms # {atom_style}", atoms, F.col("id"), F.concat_ws(" ", *[word(c) for c in columns], *[F.col(c).cast("string") for c in images]))
    if all(c in atoms.columns for c in ("vx", "vy", "vz")):
        add("Velocities", atoms.where("vx is not null"), F.col("id"), F.concat_ws(" ", F.col("id").cast("string"), word("vx"), word("vy"), word("vz")))
    for name, table in links.items():
        add(name, table, F.col("id"), F.concat_ws(" ", *[F.col(c).cast("string") for c in ("id", "type", *ENDS[: LINKS[name]])]))
    lines = spark.createDataFrame(text, "part int, row long, value string")
    for part in parts:
        lines = lines.union(part)
    write_lines(lines, ["part", "row"], path)


def write_lammps_dump(atoms: DataFrame, lo, hi, path: str, columns=("id", "type", "x", "y", "z"), frame: str = "frame") -> None:
    """Frames in order and atoms by id: one line a row, header lines counted by an aggregate."""
    heads = atoms.groupBy(frame).agg(F.count("*").alias("_n"))
    text = [
        F.lit("ITEM: TIMESTEP"), F.col(frame).cast("string"), F.lit("ITEM: NUMBER OF ATOMS"), F.col("_n").cast("string"), F.lit("ITEM: BOX BOUNDS pp pp pp"),
        *[F.lit(f"{float(a)!r} {float(b)!r}") for a, b in zip(lo, hi, strict=True)], F.lit("ITEM: ATOMS " + " ".join(columns)),
    ]
    head = heads.select(F.col(frame).alias("_f"), F.lit(0).alias("part"), F.posexplode(F.array(*text)).alias("row", "value"))
    body = atoms.select(F.col(frame).alias("_f"), F.lit(1).alias("part"), F.col("id").cast("long").alias("row"), F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value"))
    write_lines(head.select("_f", "part", F.col("row").cast("long").alias("row"), "value").union(body), ["_f", "part", "row"], path)


def read_lammps_log(spark: SparkSession, path) -> DataFrame:
    """(file, run, row, thermo): the thermodynamic output of each run of a log, as a map of its
    own columns. A run's table begins at a line of names with ``Step`` first and ends where a
    line is no row of as many numbers, such as ``Loop time``; warnings between rows are passed
    over."""
    p = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    lines = numbered_lines(spark, path).withColumn("p", p)
    told = in_sections(lines.select("file", "at", "value"), F.when(F.trim("value").rlike(r"^Step\s+\S"), F.trim("value")).when(F.trim("value").startswith("Loop time"), F.lit("")))
    rows = told.where("section <> '' and at <> opens").withColumns({"names": F.split("section", r"\s+"), "p": p})
    rows = rows.where((F.size("p") == F.size("names")) & F.forall("p", lambda w: w.try_cast("double").isNotNull()))
    runs = told.where("at = opens and section <> ''").groupBy("file").agg(F.array_sort(F.collect_set("opens")).alias("starts"))
    placed = rows.join(runs, "file").withColumn("run", F.array_position("starts", F.col("opens")).cast("int") - 1)
    # a run's table is as long as its steps of output: rows by their place, ranked within the run
    rank = F.row_number().over(Window.partitionBy("file", "run").orderBy("at")) - 1
    return placed.select("file", "run", rank.alias("row"), F.map_from_arrays("names", F.transform("p", lambda w: w.cast("double"))).alias("thermo"))


def read_lammps_log_runs(spark: SparkSession, path) -> DataFrame:
    """(file, run, seconds, procs, steps, atoms) of each ``Loop time`` line of a log."""
    pattern = r"Loop time of (\S+) on (\d+) procs for (\d+) steps with (\d+) atoms"
    lines = numbered_lines(spark, path).where(F.col("value").rlike(pattern))
    part = lambda k, kind: F.regexp_extract("value", pattern, k).try_cast(kind)
    run = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
    return lines.select("file", run.alias("run"), part(1, "double").alias("seconds"), part(2, "int").alias("procs"), part(3, "long").alias("steps"), part(4, "long").alias("atoms"))


def read_lammps_log_warnings(spark: SparkSession, path) -> DataFrame:
    """(file, text) of the warnings of a log."""
    return spark.read.text(path).where(F.col("value").startswith("WARNING:")).select(F.col("_metadata.file_path").alias("file"), F.trim(F.substring("value", 9, 10_000)).alias("text"))


def read_lammps_molecule(spark: SparkSession, path) -> LammpsData:
    """A molecule template: as a data file without a box, its sections ``Coords``, ``Types``,
    ``Charges`` and links. ``header`` has null bounds."""
    lines = numbered_lines(spark, path)
    names = "Coords|Types|Charges|Masses|Molecules|" + "|".join(LINKS)
    told = in_sections(lines, F.nullif(F.regexp_extract("value", rf"^\s*({names})\s*(#.*)?$", 1), F.lit("")))
    body = told.where("section is not null and at <> opens").withColumn("p", fields(F.col("value"))).where(F.size("p") > 0)
    at = lambda k, kind: F.get("p", F.lit(k)).try_cast(kind)
    column = lambda section, name, kind: body.where(F.col("section") == section).select("file", at(0, "long").alias("id"), at(1, kind).alias(name))
    atoms = body.where("section = 'Coords'").select("file", at(0, "long").alias("id"), *[at(1 + k, "double").alias(c) for k, c in enumerate("xyz")])
    for section, name, kind in (("Types", "type", "string"), ("Charges", "charge", "double"), ("Molecules", "mol", "long")):
        atoms = atoms.join(column(section, name, kind), ["file", "id"], "left")
    title = lines.groupBy("file").agg(F.min_by("value", "at").alias("title"))
    none = spark.createDataFrame([], "file string, section string, key string, values array<string>")
    held = LammpsData(title, atoms, column("Masses", "mass", "double"), none, none)
    for name, n in LINKS.items():
        held.links[name] = body.where(F.col("section") == name).select("file", at(0, "long").alias("id"), at(1, "string").alias("type"), *[at(2 + k, "long").alias(e) for k, e in enumerate(ENDS[:n])])
    return held
