"""Text formats of structures and trajectories as DataFrames of atoms.

Where a format names its frames, they are Spark's records (``lineSep``), and XYZ frames are told
by the numbers of their lines, so that one large file is read by many tasks. GRO, MOL2 and XSF, formats of single structures, are read a file to a record. Parsing is Column
expressions: split lines, fixed-width substrings, casts. A field that is no number becomes
null. Lengths are in Angstrom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motefield.sources.lines import numbered_lines, ranked_lines
from motefield.sources.writers import write_xyz as write_xyz
from motefield.storage import materialize

NM = 10.0
#: Lines that a frame asks for at once.
_PART = 4096


def _field(line: Column, start: int, length: int) -> Column:
    """A fixed-width field, 1-based; null where it is blank."""
    return F.nullif(F.trim(F.substring(line, start, length)), F.lit(""))


def _number(text: Column, kind: str = "double") -> Column:
    return text.try_cast(kind)


def _files(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r\n", "\n").alias("value"))


def read_lammps_dump(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """(file, timestep, lo, hi, and the columns that the dump names) of every frame.

    A record is what stands between two ``ITEM: TIMESTEP`` lines, and each is read by the names
    in its own header. Which columns there are is ``columns``, or found by a pass over the
    headers; a frame without one of them has nulls there. ``id``, ``mol``, ``type`` and image
    flags are long, ``element`` is text, all else double; what doesn't fit is null.
    """
    frames = spark.read.text(path, lineSep="ITEM: TIMESTEP\n").where(F.length(F.trim("value")) > 0)
    lines = frames.select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("l"))
    header = F.slice(F.split(F.trim(F.get(F.filter("l", lambda v: v.startswith("ITEM: ATOMS")), F.lit(0))), r"\s+"), F.lit(3), F.lit(1000))
    if columns is None:
        # as many rows as frames have different headers
        heads = frames.select(F.regexp_extract("value", "ITEM: ATOMS ([^\n]*)", 1).alias("h")).distinct().select(F.array_distinct(F.flatten(F.collect_list(F.split(F.trim("h"), r"\s+")))).alias("n")).first()
        columns = sorted({c for c in heads.n if c})
    bounds = F.transform(F.slice("l", 5, 3), lambda v: F.transform(F.split(F.trim(v), r"\s+"), lambda x: x.try_cast("double")))
    rows = lines.select(
        "file", F.trim(F.col("l")[0]).cast("long").alias("timestep"),
        F.transform(bounds, lambda b: b[0]).alias("lo"), F.transform(bounds, lambda b: b[1]).alias("hi"), header.alias("h"),
        F.explode(F.slice("l", 9, F.trim(F.col("l")[2]).cast("int"))).alias("v"),
    ).withColumn("p", F.split(F.trim("v"), r"\s+"))
    whole = {"id", "mol", "type", "ix", "iy", "iz"}
    word = lambda n: F.get("p", F.array_position("h", n).cast("int") - 1)
    return rows.select("file", "timestep", "lo", "hi", *[(word(n) if n == "element" else _number(word(n), "long" if n in whole else "double")).alias(n) for n in columns])


def read_pdb(spark: SparkSession, path, models: bool = False) -> DataFrame:
    """(file, model, id, name, res_name, chain, res_id, x, y, z, element) of atom records: of the
    first model, or with ``models`` of all."""
    records = numbered_lines(spark, path, "ENDMDL")
    # places alone are ranked, a row for each model
    ranks = records.select("file", "at").withColumn("model", F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1)
    held = records.join(ranks if models else ranks.where("model = 0"), ["file", "at"])
    lines = held.select("file", "model", F.explode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("v"))
    atoms = lines.where(F.col("v").startswith("ATOM  ") | F.col("v").startswith("HETATM"))
    v = F.col("v")
    return atoms.select(
        "file", "model", _number(_field(v, 7, 5), "long").alias("id"), _field(v, 13, 4).alias("name"), _field(v, 18, 3).alias("res_name"), _field(v, 22, 1).alias("chain"), _number(_field(v, 23, 4), "int").alias("res_id"),
        *[_number(_field(v, 31 + 8 * k, 8)).alias(c) for k, c in enumerate("xyz")], _field(v, 77, 2).alias("element"),
    )


def read_pdb_bonds(spark: SparkSession, path) -> DataFrame:
    """(file, atomi, atomj) of CONECT records, each undirected pair once."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("v")).where(F.col("v").startswith("CONECT"))
    v = F.col("v")
    ends = F.filter(F.array(*[_number(_field(v, 12 + 5 * k, 5), "long") for k in range(4)]), lambda e: e.isNotNull())
    pairs = lines.select("file", _number(_field(v, 7, 5), "long").alias("a"), F.explode(ends).alias("b"))
    return pairs.where("a is not null and a <> b").select("file", F.least("a", "b").alias("atomi"), F.greatest("a", "b").alias("atomj")).distinct()


def read_gro(spark: SparkSession, path) -> DataFrame:
    """(file, id, res_id, res_name, name, x, y, z, vx, vy, vz) of a file's first frame."""
    lines = _files(spark, path).select("file", F.split("value", "\n").alias("l"))
    rows = lines.select("file", F.posexplode(F.slice("l", 3, F.trim(F.col("l")[1]).cast("int"))).alias("k", "v"))
    v = F.col("v")
    return rows.select(
        "file", (F.col("k") + 1).cast("long").alias("id"), _number(_field(v, 1, 5), "int").alias("res_id"), _field(v, 6, 5).alias("res_name"), _field(v, 11, 5).alias("name"),
        *[(_number(_field(v, 21 + 8 * k, 8)) * NM).alias(c) for k, c in enumerate("xyz")], *[(_number(_field(v, 45 + 8 * k, 8)) * NM).alias(f"v{c}") for k, c in enumerate("xyz")],
    )


def _xyz_starts(lines: DataFrame) -> DataFrame:
    """(file, line, n, frame) of the count lines that frames begin with.

    A count line tells where the next one stands. From a file's first line all are found by
    doubling: a round goes from the frames known by as many frames as are known, so there are
    as many rounds as the number of frames has binary digits. Each joins lines that hold one number alone."""
    told = lines.select("file", "line", F.trim("value").alias("v")).where(F.col("v").rlike("^[0-9]+$"))
    counts = materialize(told.select("file", "line", F.col("v").try_cast("long").alias("n")).where("n is not null"), "xyz")
    jumps = counts.select("file", "line", (F.col("line") + F.col("n") + 2).alias("to"))
    found = lines.where("line = 0").select("file", "line", F.lit(0).cast("long").alias("frame"))
    span = 1
    while True:
        new = materialize(found.join(jumps, ["file", "line"]).select("file", F.col("to").alias("line"), (F.col("frame") + span).alias("frame")), "xyz")
        if new.isEmpty():
            break
        found = found.union(new)
        on = jumps.select("file", F.col("line").alias("to"), F.col("to").alias("then"))
        jumps = materialize(jumps.join(on, ["file", "to"]).select("file", "line", F.col("then").alias("to")), "xyz")
        span *= 2
    # behind the last frame a file has blank lines only
    last = lines.where(F.trim("value") != "").groupBy("file").agg(F.max("line").alias("last"))
    bad = found.join(counts, ["file", "line"], "left_anti").join(last, "file").where("last >= line").orderBy("file", "line").first()
    if bad is not None:
        raise ValueError(f"line {bad.line + 1} of {bad.file} should hold a frame's number of atoms")
    return found.join(counts, ["file", "line"])


def read_xyz(spark: SparkSession, path, same_size: bool = False) -> DataFrame:
    """(file, frame, comment, atom, element, x, y, z) of all frames.

    Lines are numbered over a file's splits, so a file of any size is read by many tasks.
    Frames may differ in their number of atoms; their first lines are found by rounds, and
    each frame asks for its lines by number. A file that says something else where a frame's
    number of atoms should stand is an error; one that ends within a frame gives what it has.
    With ``same_size`` all frames of a file must have as many atoms as its first one, or it is an
    error: a frame is then a number of lines by division, without rounds or a join of lines."""
    if same_size:
        return _same_size_xyz(spark, path)
    lines = ranked_lines(spark, path)
    starts = _xyz_starts(lines)
    comments = lines.select("file", (F.col("line") - 1).alias("line"), F.col("value").alias("comment"))
    heads = starts.join(comments, ["file", "line"], "left").withColumn("comment", F.coalesce("comment", F.lit("")))
    # two steps, so that a frame of any size is no long array
    parts = heads.where("n > 0").select("file", "line", "n", "frame", "comment", F.explode(F.expr(f"sequence(0L, n - 1, {_PART}L)")).alias("_from"))
    asked = parts.select("file", "frame", "comment", F.col("line").alias("_line"), F.explode(F.expr(f"sequence(_from, least(_from + {_PART}, n) - 1)")).alias("atom"))
    rows = asked.withColumn("line", F.col("_line") + F.col("atom") + 2).join(lines, ["file", "line"])
    return _xyz_rows(rows)


def _xyz_rows(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("p", F.split(F.trim("value"), r"\s+"))
    return rows.select("file", F.col("frame").cast("int").alias("frame"), "comment", "atom", F.col("p")[0].alias("element"), *[_number(F.get("p", F.lit(k + 1))).alias(c) for k, c in enumerate("xyz")])


def _same_size_xyz(spark: SparkSession, path) -> DataFrame:
    lines = ranked_lines(spark, path)
    first = lines.where("line = 0").select("file", F.trim("value").try_cast("long").alias("n"))
    step = F.col("n") + 2
    placed = lines.join(first, "file").select("file", "n", F.floor(F.col("line") / step).alias("frame"), (F.col("line") % step - 2).alias("atom"), "value")
    other = F.when((F.col("atom") == -2) & (F.trim("value") != "") & ~F.coalesce(F.trim("value").try_cast("long") == F.col("n"), F.lit(False)), F.raise_error(F.lit("frames differ in their number of atoms")).cast("string"))
    comments = placed.where("atom < 0").withColumn("_e", other).groupBy("file", "frame").agg(F.max(F.when(F.col("atom") == -1, F.col("value"))).alias("comment"), F.max("_e").alias("_e")).where("_e is null").drop("_e")
    rows = placed.where("atom >= 0").join(comments, ["file", "frame"])
    return _xyz_rows(rows)


def _section(lines: Column, opens: str, closes: str) -> Column:
    """The lines behind the first that is ``opens``, up to the next that begins with ``closes``."""
    begin = F.array_position(F.transform(lines, lambda v: F.upper(F.trim(v))), opens)
    after = F.when(begin > 0, F.slice(lines, begin + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    end = F.array_position(F.transform(after, lambda v: F.trim(v).startswith(closes)), True)
    return F.when(end > 0, F.slice(after, F.lit(1), end - 1)).otherwise(after)


def _section_fields(spark: SparkSession, path, opens: str, closes: str, least: int) -> DataFrame:
    """(file, row, p): the fields of a section's lines that have ``least`` or more."""
    lines = _files(spark, path).select("file", F.split("value", "\n").alias("l"))
    rows = lines.select("file", F.posexplode(_section(F.col("l"), opens, closes)).alias("row", "v"))
    return rows.select("file", "row", F.split(F.trim("v"), r"\s+").alias("p")).where(F.size("p") >= least)


def read_mol2(spark: SparkSession, path) -> DataFrame:
    """(file, id, name, x, y, z, type, res_id, res_name, charge) of a file's first molecule; the
    last three are null where a line leaves them out."""
    p = lambda k: F.get("p", F.lit(k))
    return _section_fields(spark, path, "@<TRIPOS>ATOM", "@<TRIPOS>", 6).select(
        "file", _number(p(0), "long").alias("id"), p(1).alias("name"), *[_number(p(2 + k)).alias(c) for k, c in enumerate("xyz")],
        p(5).alias("type"), _number(p(6), "int").alias("res_id"), p(7).alias("res_name"), _number(p(8)).alias("charge"),
    )


def read_mol2_bonds(spark: SparkSession, path) -> DataFrame:
    """(file, atomi, atomj, type) of a file's first molecule, ends as the ids of its atoms."""
    fields = _section_fields(spark, path, "@<TRIPOS>BOND", "@<TRIPOS>", 4)
    return fields.select("file", _number(F.col("p")[1], "long").alias("atomi"), _number(F.col("p")[2], "long").alias("atomj"), F.col("p")[3].alias("type"))


def read_xsf(spark: SparkSession, path) -> DataFrame:
    """(file, cell, atom, atomic_number, x, y, z) of the first primitive coordinates; ``cell`` holds
    the three primitive vectors, and is null for a file without them."""
    lines = _files(spark, path).select("file", F.split("value", "\n").alias("l"))
    vectors = F.transform(F.slice(_section(F.col("l"), "PRIMVEC", "PRIMCOORD"), 1, 3), lambda v: F.transform(F.split(F.trim(v), r"\s+"), lambda x: x.try_cast("double")))
    held = lines.select("file", F.when(F.size(vectors) == 3, vectors).alias("cell"), _section(F.col("l"), "PRIMCOORD", "PRIMCOORD").alias("s"))
    count = F.split(F.trim(F.get("s", F.lit(0))), r"\s+")[0].try_cast("int")
    rows = held.select("file", "cell", F.posexplode(F.slice("s", F.lit(2), F.coalesce(count, F.lit(0)))).alias("atom", "v")).withColumn("p", F.split(F.trim("v"), r"\s+"))
    return rows.select("file", "cell", F.col("atom").cast("long").alias("atom"), _number(F.col("p")[0], "int").alias("atomic_number"), *[_number(F.get("p", F.lit(k + 1))).alias(c) for k, c in enumerate("xyz")])
