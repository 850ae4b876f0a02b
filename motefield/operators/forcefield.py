"""Force-field terms: best-match parameter assignment and energies as expressions.

A component of a term matches a pattern by exact type (3), by the type's class (1) or by the
wildcard (0). The join does not compare each term with each pattern: a term is exploded into
the keys that could match it - every choice of type, class or wildcard, in both directions -
and equi-joined; of the matches the highest score, then layer, then earliest entry wins.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.storage import materialize

WILD = "*"


def match_terms(terms: DataFrame, ends: list[str], classes: DataFrame, patterns: DataFrame, strict: bool = False) -> DataFrame:
    """``terms`` with ``name`` and ``score`` of the best pattern, null where none fits.

    ``terms`` has ``term`` (an id) and a type for each end; ``classes`` (type, class); ``patterns``
    (name, comp array of strings, layer, ord). A term with an untyped end gets nothing; with
    ``strict`` a term without a match is an error.
    """
    # the best pattern hangs on the types only, so keys are made once for each choice of types that occurs
    rows = materialize(terms.select(*ends).dropna().distinct(), "kinds")
    for e in ends:
        rows = rows.join(classes.select(F.col("type").alias(e), F.col("class").alias(f"_{e}")).dropDuplicates([e]), e, "left")
    options = []
    for order in (ends, ends[::-1]):
        for exact in product((3, 1, 0), repeat=len(ends)):
            key = [F.col(e) if k == 3 else F.col(f"_{e}") if k == 1 else F.lit(WILD) for e, k in zip(order, exact, strict=True)]
            options.append(F.struct(F.array(*key).alias("comp"), F.lit(sum(exact)).alias("score")))
    keys = rows.select(*ends, F.explode(F.array(*options)).alias("o")).select(*ends, "o.*").where(~F.exists("comp", lambda c: c.isNull()))
    found = keys.groupBy(*ends, "comp").agg(F.max("score").alias("score")).join(patterns, "comp")
    best = found.groupBy(*ends).agg(F.max(F.struct("score", "layer", (-F.col("ord")).alias("first"), "name")).alias("_best")).select(*ends, "_best.name", "_best.score")
    # written, so that its size is known and types that many terms share need no shuffle of terms
    out = terms.join(materialize(best, "best"), ends, "left").select(*terms.columns, "name", "score")
    if strict and out.where("name is null").limit(1).count():
        raise ValueError("a term has no parameters")
    return out


def class_layers(classes: DataFrame) -> DataFrame:
    """(class, layer): the highest layer of a class's types; the placeholder type is left out."""
    return classes.where(F.col("type") != WILD).groupBy("class").agg(F.max("layer").alias("layer"))


def harmonic(x: Column, k: Column, x0: Column) -> Column:
    return 0.5 * k * (x - x0) ** 2


def morse(r: Column, d: Column, a: Column, r0: Column) -> Column:
    return d * (1 - F.exp(-a * (r - r0))) ** 2


def class2(x: Column, x0: Column, k2: Column, k3: Column, k4: Column) -> Column:
    d = x - x0
    return k2 * d**2 + k3 * d**3 + k4 * d**4


def opls_torsion(phi: Column, f1: Column, f2: Column, f3: Column, f4: Column) -> Column:
    return 0.5 * (f1 * (1 + F.cos(phi)) + f2 * (1 - F.cos(2 * phi)) + f3 * (1 + F.cos(3 * phi)) + f4 * (1 - F.cos(4 * phi)))


def periodic_torsion(phi: Column, k: Column, n: Column, phase: Column) -> Column:
    return k * (1 + F.cos(n * phi - phase))


def multi_harmonic(phi: Column, a: list[Column]) -> Column:
    return sum((c * F.cos(phi) ** i for i, c in enumerate(a)), F.lit(0.0))


def lennard_jones(r: Column, epsilon: Column, sigma: Column) -> Column:
    s6 = (sigma / r) ** 6
    return 4 * epsilon * (s6 * s6 - s6)


def lennard_jones_class2(r: Column, epsilon: Column, sigma: Column) -> Column:
    s3 = (sigma / r) ** 3
    return epsilon * (2 * s3**3 - 3 * s3**2)


def buckingham(r: Column, a: Column, rho: Column, c: Column) -> Column:
    return a * F.exp(-r / rho) - c / r**6


def coulomb(r: Column, qi: Column, qj: Column, constant: float = 332.06371) -> Column:
    return constant * qi * qj / r


def pair_energy(pairs: DataFrame, energy: Column, by=("frame",)) -> DataFrame:
    return pairs.select(*by, energy.alias("e")).groupBy(*by).agg(F.sum("e").alias("energy"))


def pair_forces(pairs: DataFrame, slope: Column, by=("frame",)) -> DataFrame:
    """(by, atom, fx, fy, fz) where ``slope`` is dE/dr of pairs with dx, dy, dz from i to j."""
    push = [slope * F.col(d) / F.col("dist") for d in ("dx", "dy", "dz")]
    row = lambda e, s: F.struct(F.col(e).alias("atom"), *[(p * s).alias(f) for p, f in zip(push, ("fx", "fy", "fz"), strict=True)])
    both = pairs.where("dist > 0").select(*by, F.explode(F.array(row("i", 1.0), row("j", -1.0))).alias("f")).select(*by, "f.*")
    return both.groupBy(*by, "atom").agg(*[F.sum(f).alias(f) for f in ("fx", "fy", "fz")])


def soft_potential(bonded: DataFrame, close: DataFrame, k: float, k_rep: float, r_c: float) -> DataFrame:
    """(frame, energy): springs on bonds (dist, r0), half-parabolas on other pairs under r_c."""
    springs = bonded.select("frame", (0.5 * k * (F.col("dist") - F.col("r0")) ** 2).alias("e"))
    bumps = close.where(F.col("dist") < r_c).select("frame", (0.5 * k_rep * (r_c - F.col("dist")) ** 2).alias("e"))
    return springs.unionByName(bumps).groupBy("frame").agg(F.sum("e").alias("energy"))


def merge_pair_parameters(atom_types: DataFrame, pair_types: DataFrame) -> DataFrame:
    """Atom types with the parameters of their pair type; the atom type's own win."""
    own = set(atom_types.columns)
    extra = pair_types.select(*[c for c in pair_types.columns if c == "type" or c not in own and c != "id"]).dropDuplicates(["type"])
    return atom_types.join(extra, "type", "left")


def fourier_torsion(phi: Column, terms: list[tuple[Column, int, Column]]) -> Column:
    """Sum of k (1 + cos(n phi - phase)) over terms of (k, n, phase)."""
    return sum((k * (1 + F.cos(n * phi - phase)) for k, n, phase in terms), F.lit(0.0))


def charmm_torsion(phi: Column, k: Column, n: Column, phase: Column) -> Column:
    return k * (1 + F.cos(n * phi - phase))


def cvff_improper(phi: Column, k: Column, sign: Column, n: Column) -> Column:
    """k (1 + d cos(n phi)), d either 1 or -1."""
    return k * (1 + sign * F.cos(n * phi))


def class2_bond_bond(r1: Column, r2: Column, m: Column, a: Column, b: Column) -> Column:
    """Cross term of two bonds of an angle."""
    return m * (r1 - a) * (r2 - b)


def class2_bond_angle(r1: Column, r2: Column, theta: Column, n1: Column, n2: Column, a: Column, b: Column, theta0: Column) -> Column:
    """Cross terms of an angle with each of its bonds."""
    return (n1 * (r1 - a) + n2 * (r2 - b)) * (theta - theta0)


def damped_coulomb(r: Column, qi: Column, qj: Column, damping: Column, constant: float = 332.06371) -> Column:
    """Coulomb's energy times a damping factor, Thole's or Tang and Toennies' for example."""
    return coulomb(r, qi, qj, constant) * damping


def scale_lj(pair_types: DataFrame, fragments: DataFrame, factors: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Pair types (i, j, epsilon, sigma) with epsilon times the factor of the fragments of i and
    j; ``fragments``: (type, fragment), ``factors``: (fragment_i, fragment_j, k) in either order. Types of
    no fragment and pairs without a factor stay. ``sigma`` scales that of pairs with one."""
    own = fragments.select("type", "fragment").dropDuplicates(["type"])
    low, high = F.least("fragment_i", "fragment_j"), F.greatest("fragment_i", "fragment_j")
    known = factors.groupBy(low.alias("_a"), high.alias("_b")).agg(F.min("k").alias("_k"))
    rows = pair_types.join(own.withColumnsRenamed({"type": "i", "fragment": "_p"}), "i", "left").join(own.withColumnsRenamed({"type": "j", "fragment": "_q"}), "j", "left")
    met = rows.join(known, (F.least("_p", "_q") == F.col("_a")) & (F.greatest("_p", "_q") == F.col("_b")) & F.col("_p").isNotNull() & F.col("_q").isNotNull(), "left")
    scaled = {"epsilon": F.col("epsilon") * F.coalesce("_k", F.lit(1.0)), "sigma": F.col("sigma") * F.when(F.col("_k").isNotNull(), sigma).otherwise(1.0)}
    return met.withColumns(scaled).select(pair_types.columns)


def write_onto(rows: DataFrame, match: DataFrame, key: str = "atom") -> DataFrame:
    """Rows with the annotations of a match of (key, names...), which win over columns of the
    rows where they are not null. A match without some of the rows is an error when the result
    is read: it is of another graph."""
    names = [c for c in match.columns if c != key]
    other = match.select(F.col(key), F.lit(True).alias("_met"), *[F.col(c).alias(f"_m_{c}") for c in names])
    joined = rows.join(other, key, "left")
    sure = F.coalesce(F.col("_met"), F.raise_error(F.lit("a match does not cover the graph")).cast("boolean"))
    old = lambda c: [F.col(c)] if c in rows.columns else []
    kept = joined.where(sure).withColumns({c: F.coalesce(F.col(f"_m_{c}"), *old(c)) for c in names})
    return kept.select(*rows.columns, *[c for c in names if c not in rows.columns])
