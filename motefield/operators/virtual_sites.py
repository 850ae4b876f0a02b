"""Sites added to atoms as rows of their own: charged shells on springs and massless sites.

An atom with a site becomes two rows in one pass, the atom with what the site left it and the
site; nothing is collected, and the charge of an atom and its site together is what it was. A
site's number is its atom's plus one more than the largest of all frames, so it needs no
numbering and is the same in every frame. Columns that are not named are the atom's on both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.operators.generators import drude_charge

#: Fixed value: kilojoules in a kilocalorie.
KCAL = 4.184


def _shift(atoms: DataFrame, atom: str) -> int:
    return int(atoms.agg(F.coalesce(F.max(atom), F.lit(-1)) + 1).first()[0])


def _with_sites(held: DataFrame, has: Column, changes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows of ``held``, those with ``has`` twice; ``changes``: a column of the atom that has a
    site, and of the site."""
    rows = held.withColumn("_site", F.explode(F.when(has, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return rows.withColumns({c: F.when(F.col("_site"), site).when(has, own).otherwise(F.col(c)) for c, (own, site) in changes.items()})


def drude_particles(atoms: DataFrame, polarizable: DataFrame, keys=("frame",), atom: str = "atom", prefix: str = "D") -> tuple[DataFrame, DataFrame]:
    """(atoms, springs): a shell at the place of each atom whose type can be polarized.

    ``atoms``: (keys, atom, type, charge, mass, x, y, z, ...). ``polarizable``: a row for each
    type with ``alpha`` in cubic Angstrom, ``spring`` in kJ/mol and square Angstrom, ``shell_mass``
    and, if it is there, ``sign`` of the shell's charge (negative without it). A type without a
    row, with null or with a spring that is not positive has no shells. The shell takes its
    charge and mass from its atom, an atom's null mass stays null; its type is the atom's behind
    ``prefix`` and its element, where atoms have one, D. ``springs``: (keys, atomi, atomj, type,
    k, r0) from atom to shell, k in kcal/mol and square Angstrom for energies of k r^2 / 2.
    """
    keys, shift = list(keys), _shift(atoms, atom)
    sign = F.when(F.coalesce(F.col("sign"), F.lit(-1)) >= 0, -1.0).otherwise(1.0) if "sign" in polarizable.columns else F.lit(1.0)
    kinds = polarizable.where("spring > 0").select("type", (sign * drude_charge(F.col("alpha"), F.col("spring"))).alias("_q"), F.col("spring").alias("_k"), F.col("shell_mass").alias("_m"))
    held, has = atoms.join(kinds, "type", "left"), F.col("_k").isNotNull()
    changes = {
        atom: (F.col(atom), F.col(atom) + F.lit(shift)), "charge": (F.col("charge") - F.col("_q"), F.col("_q")),
        "mass": (F.col("mass") - F.col("_m"), F.col("_m")), "type": (F.col("type"), F.concat(F.lit(prefix), F.col("type"))),
    }
    if "element" in atoms.columns:
        changes["element"] = (F.col("element"), F.lit("D"))
    springs = held.where(has).select(*keys, F.col(atom).alias("atomi"), (F.col(atom) + F.lit(shift)).alias("atomj"), F.lit("DRUDE").alias("type"), (F.col("_k") / KCAL).alias("k"), F.lit(0.0).alias("r0"))
    return _with_sites(held, has, changes).select(*atoms.columns), springs


def bisector_sites(atoms: DataFrame, bonds: DataFrame, distance: float, keys=("frame",), atom: str = "atom") -> tuple[DataFrame, DataFrame]:
    """(atoms, links): a massless site M on the bisector of each oxygen with two hydrogens.

    ``atoms``: (keys, atom, element, charge, x, y, z, ...), ``bonds``: (keys, atomi, atomj), in
    either direction and repeated or not. The site stands ``distance`` from its oxygen, takes
    its charge and leaves it none; where the two bonds cancel it stands on the oxygen. Oxygens
    with another number of hydrogens are left alone. ``links``: (keys, atom, site).
    """
    keys, shift = list(keys), _shift(atoms, atom)
    once = bonds.where("atomi <> atomj").select(*keys, F.least("atomi", "atomj").alias("atomi"), F.greatest("atomi", "atomj").alias("atomj")).distinct()
    both = once.select(*keys, F.explode(F.array(F.struct("atomi", "atomj"), F.struct(F.col("atomj").alias("atomi"), F.col("atomi").alias("atomj")))).alias("_b"))
    ways = both.select(*keys, F.col("_b.atomi").alias("_o"), F.col("_b.atomj").alias("_h"))
    end = lambda name, element: atoms.where(F.col("element") == element).select(*keys, F.col(atom).alias(name), *[F.col(c).alias(f"{name}{c}") for c in "xyz"])
    met = ways.join(end("_h", "H"), [*keys, "_h"]).join(end("_o", "O"), [*keys, "_o"])
    bent = met.groupBy(*keys, F.col("_o").alias(atom)).agg(F.count("*").alias("_n"), *[F.sum(F.col(f"_h{c}") - F.col(f"_o{c}")).alias(f"_{c}") for c in "xyz"]).where("_n = 2")
    size = F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2 + F.col("_z") ** 2)
    held = atoms.join(bent, [*keys, atom], "left")
    has = F.col("_n").isNotNull()
    changes = {atom: (F.col(atom), F.col(atom) + F.lit(shift)), "element": (F.col("element"), F.lit("M"))}
    changes |= {c: (F.col(c), F.col(c) + F.col(f"_{c}") / F.when(size > 0, size).otherwise(1.0) * distance) for c in "xyz"}
    if "mass" in atoms.columns:
        changes["mass"] = (F.col("mass"), F.lit(0.0))
    changes["charge"] = (F.lit(0.0), F.col("charge"))
    links = held.where(has).select(*keys, atom, (F.col(atom) + F.lit(shift)).alias("site"))
    return _with_sites(held, has, changes).select(*atoms.columns), links
