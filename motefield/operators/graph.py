"""Topology graphs: links derived by joins, hop distances, subgraphs, merging and copying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.storage import materialize


def undirected(bonds: DataFrame, a: str = "atomi", b: str = "atomj") -> DataFrame:
    """Each bond once with atomi < atomj; loops and nulls go."""
    return bonds.select(F.least(a, b).alias("atomi"), F.greatest(a, b).alias("atomj")).where(F.col("atomi") < F.col("atomj")).distinct()


def both_ends(bonds: DataFrame) -> DataFrame:
    """(a, b) of each bond both ways."""
    return bonds.select(F.explode(F.array(F.struct(F.col("atomi").alias("a"), F.col("atomj").alias("b")), F.struct(F.col("atomj").alias("a"), F.col("atomi").alias("b")))).alias("e")).select("e.*")


def angles(bonds: DataFrame) -> DataFrame:
    """(atomi, atomj, atomk): paths of two bonds, the vertex in the middle, i < k."""
    way = both_ends(undirected(bonds))
    left, right = way.select(F.col("a").alias("atomj"), F.col("b").alias("atomi")), way.select(F.col("a").alias("atomj"), F.col("b").alias("atomk"))
    return left.join(right, "atomj").where("atomi < atomk").select("atomi", "atomj", "atomk")


def dihedrals(bonds: DataFrame) -> DataFrame:
    """(atomi, atomj, atomk, atoml): paths of three bonds over four atoms, each once, j < k."""
    middle = undirected(bonds).select(F.col("atomi").alias("atomj"), F.col("atomj").alias("atomk"))
    way = both_ends(undirected(bonds))
    left, right = way.select(F.col("a").alias("atomj"), F.col("b").alias("atomi")), way.select(F.col("a").alias("atomk"), F.col("b").alias("atoml"))
    return middle.join(left, "atomj").where("atomi <> atomk").join(right, "atomk").where("atoml <> atomj and atoml <> atomi").select("atomi", "atomj", "atomk", "atoml")


def neighbors_of(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """(atom, neighbor) of the atoms listed; self-loops do not count."""
    return both_ends(undirected(bonds)).select(F.col("a").alias("atom"), F.col("b").alias("neighbor")).join(atoms.select("atom").distinct(), "atom", "left_semi")


def hop_distances(bonds: DataFrame, sources: DataFrame, radius: int | None = None) -> DataFrame:
    """(atom, hops) from the nearest source: a frontier join a round, against what is reached."""
    way = materialize(both_ends(undirected(bonds)), "ways")
    seen = frontier = materialize(sources.select("atom").distinct().withColumn("hops", F.lit(0)), "frontier")
    step = 0
    while radius is None or step < radius:
        step += 1
        reached = frontier.join(way, F.col("atom") == F.col("a")).select(F.col("b").alias("atom")).distinct()
        frontier = materialize(reached.join(seen, "atom", "left_anti").withColumn("hops", F.lit(step)), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def ball(bonds: DataFrame, centers: DataFrame, radius: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(atoms, bonds, boundary) within ``radius`` hops; boundary atoms have a bond that leaves."""
    atoms = materialize(hop_distances(bonds, centers, radius), "ball")
    one = undirected(bonds)
    inside = one.join(atoms.select(F.col("atom").alias("atomi")), "atomi", "left_semi").join(atoms.select(F.col("atom").alias("atomj")), "atomj", "left_semi")
    out = both_ends(one).join(atoms.select(F.col("atom").alias("b")), "b", "left_anti")
    return atoms, inside, atoms.select("atom").join(out.select(F.col("a").alias("atom")).distinct(), "atom", "left_semi")


def merge(atoms_a: DataFrame, bonds_a: DataFrame, atoms_b: DataFrame, bonds_b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both structures as one; the second's atoms follow the first's."""
    shift = atoms_a.agg(F.coalesce(F.max("atom") + 1, F.lit(0)).alias("_s")).first()["_s"]
    moved = bonds_b.withColumns({c: F.col(c) + shift for c in ("atomi", "atomj")})
    return atoms_a.unionByName(atoms_b.withColumn("atom", F.col("atom") + shift), allowMissingColumns=True), bonds_a.unionByName(moved, allowMissingColumns=True)


def replicate(atoms: DataFrame, bonds: DataFrame, n: int, move=None) -> tuple[DataFrame, DataFrame]:
    """``n`` copies; ``move(copy)`` maps the copy's number to a dict of new columns."""
    size = atoms.agg(F.coalesce(F.max("atom") + 1, F.lit(0)).alias("_s")).first()["_s"]
    copy = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    many = atoms.withColumn("copy", copy).withColumn("atom", F.col("atom") + F.col("copy") * size)
    links = bonds.withColumn("copy", copy).withColumns({c: F.col(c) + F.col("copy") * size for c in ("atomi", "atomj")})
    return (many.withColumns(move(F.col("copy"))) if move else many), links


def remove_atoms(atoms: DataFrame, links: list[DataFrame], condition: Column) -> tuple[DataFrame, list[DataFrame]]:
    """The structure without atoms that meet a condition, nor links that touch one."""
    gone = atoms.where(condition).select("atom").distinct()
    out = []
    for df in links:
        for c in [c for c in df.columns if c in ("atomi", "atomj", "atomk", "atoml")]:
            df = df.join(gone.select(F.col("atom").alias(c)), c, "left_anti")
        out.append(df)
    return atoms.where(~F.coalesce(condition, F.lit(False))), out


def exclude_bonded(pairs: DataFrame, bonds: DataFrame) -> DataFrame:
    """Neighbour pairs that are not bonds, of any frame or, with a column ``frame``, of their own."""
    keys = ["frame"] if "frame" in bonds.columns else []
    ends = bonds.select(*keys, F.least("atomi", "atomj").alias("i"), F.greatest("atomi", "atomj").alias("j")).where("i < j").distinct()
    return pairs.join(ends, [*keys, "i", "j"], "left_anti")
