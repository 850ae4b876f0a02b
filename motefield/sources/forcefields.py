"""Force fields and topologies as tables: XML, GROMACS, AMBER and LAMMPS command files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.sources.lines import fields, in_sections, numbered_lines, ranked_lines

#: Elements of an XML force field, and their attributes that are numbers.
XML_TAGS = {
    "Type": ("name class element def overrides", "mass"),
    "Atom": ("type class", "charge sigma epsilon"),
    "Bond": ("class1 class2 type1 type2", "length k"),
    "Angle": ("class1 class2 class3 type1 type2 type3", "angle k"),
    "Proper": ("class1 class2 class3 class4 type1 type2 type3 type4", "periodicity1 phase1 k1 periodicity2 phase2 k2 periodicity3 phase3 k3 periodicity4 phase4 k4 c0 c1 c2 c3 c4 c5"),
    "Improper": ("class1 class2 class3 class4 type1 type2 type3 type4", "periodicity1 phase1 k1"),
}


def read_xml_forcefield(spark: SparkSession, path, layer: int = 0) -> dict[str, DataFrame]:
    """Tables by element: attributes as columns, absent ones null, and ``layer``, by which a
    later file overlays an earlier one (``overlay``)."""
    tables = {}
    for tag, (words, numbers) in XML_TAGS.items():
        schema = ", ".join([*(f"`_{w}` string" for w in words.split()), *(f"`_{w}` double" for w in numbers.split())])
        rows = spark.read.schema(schema).option("rowTag", tag).format("xml").load(path)
        named = rows.select(*[F.col(c).alias(c[1:]) for c in rows.columns], F.lit(layer).alias("layer"))
        tables[tag] = named.where(F.coalesce(*[F.col(c).cast("string") for c in named.columns if c != "layer"]).isNotNull())
    return tables


def overlay(*layers: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """One force field of several: of rows with the same words, the one of the highest layer."""
    out = {}
    for tag, (words, _) in XML_TAGS.items():
        rows = layers[0][tag]
        for more in layers[1:]:
            rows = rows.unionByName(more[tag])
        keys = [w for w in words.split() if w not in ("element", "def", "overrides")]
        rest = [c for c in rows.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "layer").alias("_b"))
        out[tag] = best.select(*keys, "_b.*")
    return out


#: Sections of a topology whose fields have names.
TOP = {
    "defaults": ["nbfunc", "comb_rule", "gen_pairs", "fudge_lj", "fudge_qq"],
    "atoms": ["nr", "type", "resnr", "residue", "atom", "cgnr", "charge", "mass"],
    "bonds": ["ai", "aj", "funct"],
    "pairs": ["ai", "aj", "funct"],
    "angles": ["ai", "aj", "ak", "funct"],
    "dihedrals": ["ai", "aj", "ak", "al", "funct"],
    "bondtypes": ["i", "j", "funct"],
    "angletypes": ["i", "j", "k", "funct"],
    "dihedraltypes": ["i", "j", "k", "l", "funct"],
    "moleculetype": ["name", "nrexcl"],
    "molecules": ["name", "count"],
}
NUMBERS = {"nr": "long", "resnr": "int", "cgnr": "int", "charge": "double", "mass": "double", "ai": "long", "aj": "long", "ak": "long", "al": "long", "funct": "int", "nrexcl": "int", "count": "long"}


def read_gromacs_topology(spark: SparkSession, path) -> dict[str, DataFrame]:
    """Tables by section of top and itp files: (file, molecule, the section's fields, params),
    where ``params`` holds the words behind the named fields and ``molecule`` the molecule type
    that the section belongs to. Lines of the preprocessor are left out: what they include is
    read by naming its file. ``atomtypes`` has its words in ``params`` alone."""
    lines = numbered_lines(spark, path).withColumn("value", F.trim(F.regexp_replace("value", ";.*", ""))).where("value <> '' and not startswith(value, '#')")
    told = in_sections(lines, F.nullif(F.lower(F.regexp_extract("value", r"^\[\s*(\w+)\s*\]", 1)), F.lit("")))
    body = told.where("section is not null and at <> opens").withColumn("p", fields(F.col("value"), None))
    names = body.where("section = 'moleculetype'").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", F.get("p", F.lit(0)).alias("name")))).alias("_m"))
    held = body.join(names, "file", "left").withColumn("_b", F.filter("_m", lambda m: m["at"] <= F.col("at")))
    named = held.withColumn("molecule", F.when(F.size("_b") > 0, F.element_at("_b", -1)["name"]))
    out = {}
    for section, columns in {**TOP, "atomtypes": []}.items():
        at = [F.get("p", F.lit(k)).try_cast(NUMBERS.get(c, "string")).alias(c) for k, c in enumerate(columns)]
        rest = F.slice("p", len(columns) + 1, F.greatest(F.size("p") - len(columns), F.lit(0)))
        out[section] = named.where(F.col("section") == section).select("file", "molecule", *at, rest.alias("params"))
    return out


def read_amber_topology(spark: SparkSession, path) -> DataFrame:
    """(file, flag, index, value) of a prmtop file: a section is a record, its values are cut by
    the width that its format line gives; blank values are kept as empty text."""
    records = spark.read.text(path, lineSep="%FLAG ").where(F.col("value").contains("%FORMAT"))
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    parts = records.select(F.col("_metadata.file_path").alias("file"), F.trim(lines[0]).alias("flag"), F.regexp_extract("value", r"%FORMAT\(\d+[a-zA-Z](\d+)", 1).try_cast("int").alias("width"), F.array_join(F.filter(F.slice(lines, 2, 1_000_000_000), lambda v: ~v.startswith("%")), "").alias("body"))
    sized = parts.withColumn("n", F.ceil(F.length("body") / F.col("width")).try_cast("int")).where("n > 0")
    cut = sized.select("file", "flag", "width", "body", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("index"))
    return cut.select("file", "flag", F.col("index").try_cast("long").alias("index"), F.trim(F.col("body").substr(F.col("index") * F.col("width") + 1, F.col("width"))).alias("value"))


def amber_atoms(topology: DataFrame) -> DataFrame:
    """(file, atom, name, type, charge, mass, type_index) of ``read_amber_topology``; charges in
    units of the electron's, from 0."""
    one = lambda flag, name, kind: topology.where(F.col("flag") == flag).select("file", F.col("index").alias("atom"), F.col("value").cast(kind).alias(name))
    atoms = one("ATOM_NAME", "name", "string")
    for flag, name, kind in (("AMBER_ATOM_TYPE", "type", "string"), ("CHARGE", "charge", "double"), ("MASS", "mass", "double"), ("ATOM_TYPE_INDEX", "type_index", "int")):
        atoms = atoms.join(one(flag, name, kind), ["file", "atom"], "left")
    return atoms.withColumn("charge", F.col("charge") / 18.2223)


def amber_bonds(topology: DataFrame) -> DataFrame:
    """(file, atomi, atomj, type_index) from 0: triples of three times the index."""
    values = topology.where(F.col("flag").isin("BONDS_INC_HYDROGEN", "BONDS_WITHOUT_HYDROGEN")).select("file", "flag", F.floor(F.col("index") / 3).alias("bond"), (F.col("index") % 3).alias("k"), F.col("value").try_cast("long").alias("v"))
    rows = values.groupBy("file", "flag", "bond").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}") for k in range(3)])
    return rows.where("v2 is not null").select("file", F.floor(F.col("v0") / 3).alias("atomi"), F.floor(F.col("v1") / 3).alias("atomj"), F.col("v2").try_cast("int").alias("type_index"))


def read_inpcrd(spark: SparkSession, path) -> DataFrame:
    """(file, atom, x, y, z) of AMBER coordinates: fields of twelve characters, six a line."""
    lines = ranked_lines(spark, path)
    counts = lines.where("line = 1").select("file", F.split(F.trim("value"), r"\s+")[0].try_cast("long").alias("n"))
    body = lines.where("line > 1").join(counts, "file").select("file", "n", F.col("line"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.trim(F.col("value").substr(k * 12 + 1, F.lit(12))))).alias("k", "w"))
    placed = body.where("w <> ''").withColumn("i", (F.col("line") - 2) * 6 + F.col("k")).where(F.col("i") < 3 * F.col("n"))
    return placed.groupBy("file", F.floor(F.col("i") / 3).alias("atom")).agg(*[F.max(F.when(F.col("i") % 3 == k, F.col("w").try_cast("double"))).alias(c) for k, c in enumerate("xyz")])


def read_frcmod(spark: SparkSession, path) -> DataFrame:
    """(file, section, types, values): parameter lines of an AMBER modification file, types
    without blanks as in ``c3-c3``, values as far as words are numbers."""
    lengths = {"MASS": 2, "BOND": 5, "ANGL": 8, "DIHE": 11, "IMPR": 11, "NONB": 4}
    told = in_sections(numbered_lines(spark, path), F.nullif(F.substring(F.regexp_extract("value", r"^\s*(MASS|BOND|ANGLE?|DIHE|IMPROPER|IMPR|NONBON)\s*$", 1), 1, 4), F.lit("")))
    rows = told.where("section is not null and at <> opens and trim(value) <> ''")
    width: Column = F.lit(2)
    for name, n in lengths.items():
        width = F.when(F.col("section") == name, n).otherwise(width)
    text = F.ltrim("value")
    return rows.withColumn("_w", width).select("file", "section", F.regexp_replace(text.substr(F.lit(1), F.col("_w")), r"\s", "").alias("types"), F.filter(F.transform(F.split(F.trim(text.substr(F.col("_w") + 1, F.lit(10_000))), r"\s+"), lambda w: w.try_cast("double")), lambda v: v.isNotNull()).alias("values"))


def read_lammps_forcefield(spark: SparkSession, path) -> DataFrame:
    """(file, command, keys, values) of coefficient commands: ``pair_coeff`` has two keys, all
    others one. Other commands are left out, and what ``include`` names is read by its path."""
    p = fields(F.col("value"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), p.alias("p")).where(F.size("p") > 1)
    keys = F.when(F.get("p", F.lit(0)) == "pair_coeff", 2).otherwise(1)
    return lines.where(F.get("p", F.lit(0)).endswith("_coeff")).select("file", F.get("p", F.lit(0)).alias("command"), F.slice("p", F.lit(2), keys).alias("keys"), F.slice("p", keys + 2, F.greatest(F.size("p") - 1 - keys, F.lit(0))).alias("values"))


def write_lammps_forcefield(rows: DataFrame, path: str) -> None:
    """The inverse of ``read_lammps_forcefield``, in the order of commands and keys."""
    line = F.concat_ws(" ", "command", F.array_join("keys", " "), F.array_join("values", " "))
    rows.select("command", "keys", line.alias("value")).orderBy("command", "keys").select("value").write.text(path)


def read_csv_block(spark: SparkSession, path, header: bool = True, names: list[str] | None = None, delimiter: str = ",") -> DataFrame:
    """A table of integers, floats and text by what its columns hold; ``names`` replace or, with
    no header, give the columns. An empty file gives no rows."""
    rows = spark.read.csv(path, header=header, inferSchema=True, sep=delimiter, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    kinds = {"int": "bigint", "date": "string", "timestamp": "string", "timestamp_ntz": "string", "boolean": "string"}
    plain = rows.select(*[F.col(f"`{c}`").cast(kinds[t]).alias(c) if t in kinds else F.col(f"`{c}`") for c, t in rows.dtypes])
    return plain.toDF(*names) if names else plain
