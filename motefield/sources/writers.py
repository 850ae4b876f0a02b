"""Writers of structure files and trajectories: one line a row, sorted by range partitions.

Each writes a folder of text files that, one behind the other by name, are the format's file.
Frames are (frame, atom, ...); a frame's header lines come from an aggregate of its atoms. No
frame is gathered into one row, so a frame of any size is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.sources.lines import write_lines


def _framed(atoms: DataFrame, head: list[Column], line: Column, tail: list[Column], path: str, frame: str = "frame", atom: str = "atom", extra: DataFrame | None = None) -> None:
    """Header lines, a line for each atom and closing lines, of each frame in order; ``extra``:
    (frame, row, value) lines between the atoms and the closing ones."""
    counts = atoms.groupBy(frame).agg(F.count("*").alias("_n"))

    def fixed(texts: list[Column], part: int) -> DataFrame:
        held = F.array(*texts) if texts else F.array().cast("array<string>")
        return counts.select(F.col(frame).alias("_f"), F.lit(part).alias("_part"), F.posexplode(held).alias("_row", "value")).select("_f", "_part", F.col("_row").cast("long").alias("_row"), "value")

    lines = fixed(head, 0).union(atoms.select(F.col(frame).alias("_f"), F.lit(1).alias("_part"), F.col(atom).cast("long").alias("_row"), line.alias("value"))).union(fixed(tail, 3))
    if extra is not None:
        lines = lines.union(extra.select(F.col("frame").alias("_f"), F.lit(2).alias("_part"), F.col("row").cast("long").alias("_row"), "value"))
    write_lines(lines, ["_f", "_part", "_row"], path)


def write_xyz(atoms: DataFrame, path: str, frame: str = "frame") -> None:
    """(frame, atom, element, x, y, z) as XYZ frames whose comment names the frame."""
    line = F.concat_ws(" ", "element", *[F.format_string("%.6f", F.col(c)) for c in "xyz"])
    _framed(atoms, [F.col("_n").cast("string"), F.concat(F.lit("frame "), F.col(frame).cast("string"))], line, [], path, frame)


def write_pdb(atoms: DataFrame, path: str, bonds: DataFrame | None = None, frame: str = "frame") -> None:
    """(frame, atom, name, res_name, chain, res_id, x, y, z, element) as models; ``bonds``:
    (frame, atomi, atomj), each written once with its lesser end first. Serial numbers and
    residues beyond what their fields hold start anew."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(
        F.lit("ATOM  "), F.format_string("%5d ", F.col("atom") % 100_000), F.rpad(F.concat(F.when(F.length(text("name")) < 4, " ").otherwise(""), text("name")), 4, " "), F.lit(" "), F.lpad(text("res_name"), 3, " "), F.lit(" "), F.rpad(text("chain"), 1, " "),
        F.format_string("%4d    ", F.coalesce(F.col("res_id"), F.lit(1)) % 10_000), *[F.format_string("%8.3f", F.col(c)) for c in "xyz"], F.lit("  1.00  0.00          "), F.lpad(text("element"), 2, " "),
    )
    links = None
    if bonds is not None:
        low, high = F.least("atomi", "atomj"), F.greatest("atomi", "atomj")
        links = bonds.select(F.col(frame).alias("frame"), low.alias("a"), high.alias("b")).distinct().select("frame", F.col("a").alias("row"), F.concat(F.lit("CONECT"), F.format_string("%5d%5d", F.col("a") % 100_000, F.col("b") % 100_000)).alias("value"))
    _framed(atoms, [F.concat(F.lit("MODEL     "), F.format_string("%4d", F.col(frame)))], line, [F.lit("ENDMDL")], path, frame, extra=links)


def write_gro(atoms: DataFrame, box, path: str, frame: str = "frame") -> None:
    """(frame, atom, res_id, res_name, name, x, y, z) in Angstrom as frames in nanometres, with
    three box lengths in Angstrom."""
    wrapped = lambda c: F.coalesce(F.col(c), F.lit(1)) % 100_000
    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, 5)
    line = F.concat(F.format_string("%5d", wrapped("res_id")), F.rpad(cut("res_name"), 5, " "), F.lpad(cut("name"), 5, " "), F.format_string("%5d", wrapped("atom")), *[F.format_string("%8.3f", F.col(c) / 10) for c in "xyz"])
    last = "".join(f"{float(b) / 10:10.5f}" for b in box)
    _framed(atoms, [F.concat(F.lit("frame t= "), F.col(frame).cast("string")), F.format_string("%5d", F.col("_n"))], line, [F.lit(last)], path, frame)


def write_mol2(atoms: DataFrame, path: str, bonds: DataFrame | None = None, frame: str = "frame") -> None:
    """(frame, atom, name, x, y, z, type, res_id, res_name, charge) as molecules; ``bonds``:
    (frame, atomi, atomj, type). Bonds are numbered by their ends within a frame by as many as
    the frame has, counted in the header."""
    head = [F.lit("@<TRIPOS>MOLECULE"), F.concat(F.lit("frame "), F.col(frame).cast("string")), F.col("_n").cast("string"), F.lit("SMALL"), F.lit("USER_CHARGES"), F.lit("@<TRIPOS>ATOM")]
    line = F.concat_ws(" ", F.col("atom").cast("string"), "name", *[F.format_string("%.4f", F.col(c)) for c in "xyz"], "type", F.coalesce(F.col("res_id"), F.lit(1)).cast("string"), F.coalesce(F.col("res_name"), F.lit("MOL")), F.format_string("%.4f", F.coalesce(F.col("charge"), F.lit(0.0))))
    links = None
    if bonds is not None:
        opened = bonds.select(F.col(frame).alias("frame")).distinct().select("frame", F.lit(-1).cast("long").alias("row"), F.lit("@<TRIPOS>BOND").alias("value"))
        number = F.col("atomi") * (1 << 31) + F.col("atomj")
        links = opened.union(bonds.select(F.col(frame).alias("frame"), number.alias("row"), F.concat_ws(" ", number.cast("string"), F.col("atomi").cast("string"), F.col("atomj").cast("string"), F.coalesce(F.col("type").cast("string"), F.lit("un"))).alias("value")))
    _framed(atoms, head, line, [], path, frame, extra=links)


def write_xsf(atoms: DataFrame, cell, path: str, frame: str = "frame") -> None:
    """(frame, atom, atomic_number, x, y, z) as primitive coordinates of a crystal with three
    cell vectors."""
    head = [F.lit("CRYSTAL"), F.lit("PRIMVEC"), *[F.lit(" ".join(f"{float(v):.8f}" for v in row)) for row in cell], F.lit("PRIMCOORD"), F.concat(F.col("_n").cast("string"), F.lit(" 1"))]
    _framed(atoms, head, F.concat_ws(" ", F.col("atomic_number").cast("string"), *[F.format_string("%.8f", F.col(c)) for c in "xyz"]), [], path, frame)
