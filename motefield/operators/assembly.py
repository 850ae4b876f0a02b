"""Choosing sites and pairs of sites, counting and labelling them, and laying out copies.

Sites are rows with an id (``atom``), a molecule (``mol``) and a place; candidates are pairs of
sites with their distance. Pairing needs a cutoff: without one every site meets every other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.functions.box import Box
from motefield.operators.neighbors import cross_pairs
from motefield.storage import forget, materialize


def site_pairs(a: DataFrame, b: DataFrame, box: Box, cutoff: float, keys=("frame",), same_molecule: bool = False) -> DataFrame:
    """(keys, i, j, dist) of sites of ``a`` and ``b`` within the cutoff, those of one molecule
    left out unless ``same_molecule``. Both have ``keys``, atom, mol, x, y, z."""
    near = cross_pairs(a, b, box, cutoff, keys=keys, carry=("mol",)).where("i <> j")
    kept = near if same_molecule else near.where("mol_i <> mol_j")
    return kept.select(*keys, "i", "j", "dist")


def candidate_rank(pairs: DataFrame, by=("frame",)) -> DataFrame:
    """Candidates with their place in the order nearest first, those without a distance last,
    then by their sites; one order for each group of ``by``."""
    order = Window.partitionBy(*by).orderBy(F.col("dist").isNull(), "dist", "i", "j")
    return pairs.withColumn("rank", F.row_number().over(order))


def disjoint_pairs(pairs: DataFrame, keys=("frame",), limit: int | None = None, rounds: int = 10_000) -> DataFrame:
    """The pairs that nearest-first choice takes, each site used once; ``limit``: the first of
    them by distance.

    A pair that comes before all others at both of its sites is taken whatever the rest are, so
    a round takes all such pairs at once, drops those that touch them, and starts anew. Each
    round is two aggregates and two joins; no group is walked in order.
    """
    keys = list(keys)
    left = materialize(pairs.where("i <> j").select(*keys, "i", "j", "dist").distinct(), "candidates")
    order = F.struct(F.col("dist").isNull().alias("n"), "dist", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "i", "j")
    taken = None
    for _ in range(rounds):
        ends = left.select(*keys, F.explode(F.array("i", "j")).alias("site"), order.alias("o"))
        best = materialize(ends.groupBy(*keys, "site").agg(F.min("o").alias("o")), "best")
        both = best.groupBy(*keys, "o").agg(F.count("*").alias("n")).where("n = 2").select(*keys, F.col("o.i").alias("i"), F.col("o.j").alias("j"), F.col("o.dist").alias("dist"))
        new = materialize(both, "taken")
        forget(best)
        if new.isEmpty():
            break
        taken = new if taken is None else taken.union(new)
        used = materialize(new.select(*keys, F.explode(F.array("i", "j")).alias("site")), "used")
        rest = left.join(used.withColumnRenamed("site", "i"), [*keys, "i"], "left_anti").join(used.withColumnRenamed("site", "j"), [*keys, "j"], "left_anti")
        old, left = left, materialize(rest.select(*keys, "i", "j", "dist"), "candidates")
        forget(old)
        forget(used)
    else:
        raise RuntimeError(f"pairs are left after {rounds} rounds")
    chosen = left.limit(0) if taken is None else taken
    return chosen if limit is None else chosen.orderBy(F.col("dist").isNull(), "dist", *keys, "i", "j").limit(limit)


def every_nth(sites: DataFrame, step: int, by=("mol",), order=("atom",), start: int = 0) -> DataFrame:
    """Each ``step``-th site of a molecule in its order, from the ``start``-th on."""
    if step < 1:
        raise ValueError("a step is at least one")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1 - start
    return sites.withColumn("_p", place).where((F.col("_p") >= 0) & (F.col("_p") % step == 0)).drop("_p")


def label_sites(sites: DataFrame, step: int, label: str, by=("mol",), order=("atom",)) -> DataFrame:
    """All sites, with ``label`` in the column ``site`` of each ``step``-th and null elsewhere."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return sites.withColumn("site", F.when(place % step == 0, F.lit(label)))


def limiting_count(pairs: DataFrame, conversion: float) -> DataFrame:
    """(sites_a, sites_b, n): pairs to take so that a share of the scarcer kind reacts."""
    if not 0 <= conversion <= 1:
        raise ValueError("a conversion lies between 0 and 1")
    counts = pairs.agg(F.countDistinct("i").alias("sites_a"), F.countDistinct("j").alias("sites_b"))
    return counts.withColumn("n", F.ceil(conversion * F.least("sites_a", "sites_b")).cast("long"))


def tally(rows: DataFrame, kind: str, by=()) -> DataFrame:
    """(by, kind, n): the composition of each group, nulls a kind of their own."""
    return rows.groupBy(*by, kind).agg(F.count("*").alias("n"))


def label_order(label: Column) -> Column:
    """Sorts labels that are all digits by number and before the others, which sort as text."""
    digits = label.rlike(r"^\d+$")
    return F.struct((~digits).alias("text"), F.when(digits, label.cast("decimal(38,0)")).alias("number"), label.alias("label"))


def type_map(*tables: DataFrame, column: str = "type") -> DataFrame:
    """(type, id): ids from 1 for all labels of some tables, in the order of labels.

    The window goes over the different labels alone, which a force field bounds."""
    labels = tables[0].select(F.col(column).cast("string").alias("type"))
    for more in tables[1:]:
        labels = labels.union(more.select(F.col(column).cast("string")))
    different = labels.where("type is not null").distinct()
    return different.withColumn("id", F.row_number().over(Window.orderBy(label_order(F.col("type")))).cast("long"))


def beads_of(atoms: DataFrame, members: DataFrame) -> DataFrame:
    """(atom, beads): the beads that hold each atom, in order; ``members``: (bead, atom). An atom
    of no bead has an empty array, and one may be in several."""
    held = members.where("bead is not null").groupBy("atom").agg(F.array_sort(F.collect_set("bead")).alias("beads"))
    return atoms.select("atom").join(held, "atom", "left").withColumn("beads", F.coalesce("beads", F.array().cast(held.schema["beads"].dataType)))


def replicas_grid(strand: DataFrame, n: int, spacing: float, jitter: float = 0.0, rotate: bool = True, seed: int = 0) -> DataFrame:
    """``n``^3 copies of (atom, x, y, z, ...) on a cubic lattice, ``mol`` from 1.

    A copy's rotation is a unit quaternion of three numbers that a hash of the seed and its
    number give, and so is its jitter: a task that runs again lays the same copy.
    """
    if n < 1 or spacing <= 0:
        raise ValueError("at least one copy, a positive distance apart")

    def unit(k: int) -> Column:
        return (F.xxhash64(F.lit(seed), F.lit(k), "_c").bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)

    copies = strand.sparkSession.range(n**3).select(F.col("id").alias("_c"))
    u, v, w = unit(0), 2 * math.pi * unit(1), 2 * math.pi * unit(2)
    q = [F.sqrt(1 - u) * F.sin(v), F.sqrt(1 - u) * F.cos(v), F.sqrt(u) * F.sin(w), F.sqrt(u) * F.cos(w)]
    copies = copies.select("_c", *[c.alias(f"_q{k}") for k, c in enumerate(q)], *[((unit(3 + k) * 2 - 1) * jitter).alias(f"_j{k}") for k in range(3)])
    a, b, c, d = (F.col(f"_q{k}") for k in range(4))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    turned = (
        (1 - 2 * (b * b + c * c)) * x + 2 * (a * b - c * d) * y + 2 * (a * c + b * d) * z,
        2 * (a * b + c * d) * x + (1 - 2 * (a * a + c * c)) * y + 2 * (b * c - a * d) * z,
        2 * (a * c - b * d) * x + 2 * (b * c + a * d) * y + (1 - 2 * (a * a + b * b)) * z,
    ) if rotate else (x, y, z)
    at = [F.floor(F.col("_c") / n**2), F.floor(F.col("_c") / n) % n, F.col("_c") % n]
    # every copy has every atom of the strand: that product is what is asked for
    rows = copies.crossJoin(strand)
    moved = {p: t + o * spacing + F.col(f"_j{k}") for k, (p, t, o) in enumerate(zip("xyz", turned, at, strict=True))}
    return rows.withColumns({**moved, "mol": (F.col("_c") + 1).cast("long")}).drop("_c", *[f"_q{k}" for k in range(4)], *[f"_j{k}" for k in range(3)])


def replicas_line(strand: DataFrame, count: int, spacing: float = 10.0) -> DataFrame:
    """``count`` copies along x, ``mol`` from 1."""
    if count < 1:
        raise ValueError("at least one copy")
    copies = strand.sparkSession.range(count).select(F.col("id").alias("_c"))
    return copies.crossJoin(strand).withColumns({"x": F.col("x") + F.col("_c") * spacing, "mol": F.col("_c") + 1}).drop("_c")
