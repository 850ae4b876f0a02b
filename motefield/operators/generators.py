"""Generators of structures: lattices, crystals, symmetry copies, chains and virtual sites."""

from __future__ import annotations

import math
import re
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fractional sites of the common lattices.
BASES = {
    "sc": [(0, 0, 0)],
    "bcc": [(0, 0, 0), (0.5, 0.5, 0.5)],
    "fcc": [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)],
}


def lattice_basis(kind: str, species: str | tuple[str, str] = "A") -> list[tuple[float, float, float, str]]:
    """Sites (u, v, w, species) of a cubic cell."""
    if kind == "rocksalt":
        a, b = species
        return [(*s, a) for s in BASES["fcc"]] + [((u + 0.5) % 1, v, w, b) for u, v, w in BASES["fcc"]]
    return [(*s, species) for s in BASES[kind]]


def build_crystal(spark: SparkSession, cell: list[list[float]], basis: list[tuple], repeats: tuple[int, int, int], inside: Column | None = None) -> DataFrame:
    """(atom, species, x, y, z): the basis tiled over repeats, then clipped. Rows of ``cell`` are
    lattice vectors. Tiles are generated in parallel, not listed on the driver."""
    na, nb, nc = repeats
    sites = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(float(v)).alias(n) for v, n in zip(s[:3], "uvw", strict=True)], F.lit(s[3]).alias("species")) for k, s in enumerate(basis)])
    tiles = spark.range(na * nb * nc).select(F.col("id"), (F.col("id") % na).alias("a"), (F.floor(F.col("id") / na) % nb).alias("b"), F.floor(F.col("id") / (na * nb)).alias("c"), F.explode(sites).alias("s"))
    frac = [F.col(t) + F.col(f"s.{u}") for t, u in zip("abc", "uvw", strict=True)]
    xyz = [sum((f * float(cell[i][j]) for i, f in enumerate(frac)), F.lit(0.0)).alias(n) for j, n in enumerate("xyz")]
    rows = tiles.select((F.col("id") * len(basis) + F.col("s.k")).alias("atom"), F.col("s.species").alias("species"), *xyz)
    return rows.where(inside) if inside is not None else rows


def parse_triplet(text: str) -> tuple[np.ndarray, list[Fraction]]:
    """Rotation and translation of a symmetry operation such as ``-y+1/2, x, z``: three sums of
    whole multiples of x, y, z and of fractions or decimals. Anything else is an error."""
    parts = re.sub(r"\s", "", text.lower()).split(",")
    if len(parts) != 3:
        raise ValueError(f"{text!r} has {len(parts)} components for 3")
    rotation, shift = np.zeros((3, 3), dtype=int), []
    for i, part in enumerate(parts):
        terms = re.findall(r"([+-]?)(?:(\d*)\*?([xyz])|(\d+(?:\.\d+)?(?:/\d+)?))(?=[+-]|$)", part)
        if not part or "".join(s + (n + a if a else v) for s, n, a, v in terms) != part.replace("*", ""):
            raise ValueError(f"{part!r} in {text!r} is no sum of x, y, z and numbers")
        moved = Fraction(0)
        for sign, count, axis, value in terms:
            s = -1 if sign == "-" else 1
            if axis:
                rotation[i, "xyz".index(axis)] += s * int(count or 1)
            else:
                moved += s * Fraction(*map(Fraction, value.split("/")))
        shift.append(moved % 1)
    return rotation, shift


def close_group(triplets: list[str], most: int = 1536) -> list[tuple[np.ndarray, list[Fraction]]]:
    """All products of the operations; an error beyond ``most`` of them."""
    key = lambda op: (op[0].tobytes(), tuple(op[1]))
    known = {key(op): op for op in [parse_triplet("x,y,z"), *map(parse_triplet, triplets)]}
    todo = list(known.values())
    while todo:
        new = []
        for a in todo:
            for b in list(known.values()):
                for p, q in ((a, b), (b, a)):
                    op = (p[0] @ q[0], [(sum((int(p[0][i, j]) * q[1][j] for j in range(3)), Fraction(0)) + p[1][i]) % 1 for i in range(3)])
                    if key(op) not in known:
                        known[key(op)] = op
                        new.append(op)
                        if len(known) > most:
                            raise ValueError("the operations do not close")
        todo = new
    return list(known.values())


def equivalent_positions(sites: DataFrame, triplets: list[str], digits: int = 5, close: bool = True) -> DataFrame:
    """(columns of sites, u, v, w): every operation on every site, equal places once. Operations
    are generators of a group, or with ``close`` off the whole list of them."""
    ops = close_group(triplets) if close else [parse_triplet(t) for t in triplets]
    moved = F.array(*[F.struct(*[F.pmod(sum((F.col(c) * int(r[i, j]) for j, c in enumerate("uvw") if r[i, j]), F.lit(float(t[i]))), F.lit(1.0)).alias(n) for i, n in enumerate("uvw")]) for r, t in ops])
    others = [c for c in sites.columns if c not in ("u", "v", "w")]
    rows = sites.select(*others, F.explode(moved).alias("p")).select(*others, *[F.round(F.pmod(F.round(F.col(f"p.{n}"), digits), F.lit(1.0)), digits).alias(n) for n in "uvw"])
    return rows.distinct()


def flory_schulz_pmf(n: Column, p: float) -> Column:
    """Weight of chains of n units: n (1-p)^2 p^(n-1)."""
    return n * (1 - p) ** 2 * F.pow(F.lit(p), n - 1)


def truncated_poisson_pmf(n: Column, mean: float) -> Column:
    """Poisson of at least one unit."""
    return F.exp(n * math.log(mean) - mean) / F.factorial(n.cast("int")) / (1 - math.exp(-mean))


def schulz_zimm_pdf(m: Column, mn: float, mw: float) -> Column:
    """Gamma density of chain masses with number mean ``mn`` and weight mean ``mw``."""
    z, scale = mn / (mw - mn), mw - mn
    return F.exp((z - 1) * F.ln(m) - m / scale - math.lgamma(z) - z * math.log(scale))


def sample_chains(spark: SparkSession, n: int, draw, seed: int = 0, partitions: int = 8) -> DataFrame:
    """(chain, value): ``draw(generator, size)`` of numpy for each row range, seeded by its first
    row, so a task that is run again draws the same."""

    def run(batches):
        for rows in batches:
            if len(rows):
                yield pd.DataFrame({"chain": rows["id"], "value": np.asarray(draw(np.random.default_rng((seed, int(rows["id"].iloc[0]))), len(rows)), dtype=float)})

    return spark.range(0, n, 1, partitions).mapInPandas(run, "chain long, value double")


def plan_system(chains: DataFrame, target: float, slack: float = 0.02, block: int = 10_000) -> DataFrame:
    """Chains in order until their mass reaches the target; one that would pass the target by
    more than the slack ends the plan. Running sums are taken in blocks of chains and then
    over blocks, so no task holds all chains."""
    rows = chains.withColumn("_b", F.floor(F.col("chain") / block))
    sums = rows.groupBy("_b").agg(F.sum("value").alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_s")
    run = F.sum("value").over(Window.partitionBy("_b").orderBy("chain"))
    total = rows.join(before, "_b").withColumn("cumulative", F.col("_before") + run).drop("_b", "_before")
    return total.where((F.col("cumulative") - F.col("value") < target) & (F.col("cumulative") <= target * (1 + slack)))


def alternating_sequence(units: list[str], n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(F.array(*map(F.lit, units)), (i % len(units) + 1).cast("int")))


def weighted_sequence(units: dict[str, float], n: Column, key: Column, seed: int = 0) -> Column:
    """``n`` units drawn by weight, each by a hash of seed, ``key`` (the chain) and place, so that
    a task that runs again draws the same."""
    total, edges, at = sum(units.values()), [], 0.0
    for w in units.values():
        at += w / total
        edges.append(at)

    def drawn(i: Column) -> Column:
        u = F.xxhash64(F.lit(seed), key, i).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)
        names = list(units)
        out = F.lit(names[-1])
        for name, edge in reversed(list(zip(names[:-1], edges[:-1], strict=True))):
            out = F.when(u < edge, name).otherwise(out)
        return out

    return F.transform(F.sequence(F.lit(0), n - 1), drawn)


def block_sequence(fractions: dict[str, float], n: int) -> list[tuple[str, int]]:
    """Units of each block of n, by largest remainder."""
    total = sum(fractions.values())
    exact = {u: n * f / total for u, f in fractions.items()}
    counts = {u: int(v) for u, v in exact.items()}
    for u in sorted(exact, key=lambda u: counts[u] - exact[u])[: n - sum(counts.values())]:
        counts[u] += 1
    return list(counts.items())


#: Fixed value: 4 pi eps0 in e^2 / (kJ/mol Angstrom), for polarizabilities in cubic Angstrom.
COULOMB = 1389.35458


def drude_charge(alpha: Column, spring: Column) -> Column:
    """Charge of a Drude particle, negative, of a polarizability and a spring constant."""
    return -F.sqrt(alpha * spring / COULOMB)


def bisector_site(atoms: DataFrame, waters: DataFrame, distance: float) -> DataFrame:
    """(water, x, y, z): a site on the bisector of each water (o, h1, h2), that far from o."""
    out = waters
    for e in ("o", "h1", "h2"):
        out = out.join(atoms.select(F.col("atom").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in "xyz"]), e)
    d = [F.col(f"{c}_h1") + F.col(f"{c}_h2") - 2 * F.col(f"{c}_o") for c in "xyz"]
    size = F.sqrt(d[0] ** 2 + d[1] ** 2 + d[2] ** 2)
    return out.select("water", *[(F.col(f"{c}_o") + v / size * distance).alias(c) for c, v in zip("xyz", d, strict=True)])
