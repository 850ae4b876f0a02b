"""Clusters of neighbour graphs, moments of shape, and two learned descriptions.

Clusters are components of the pair table, found without gathering a frame; nodes are keyed by
frame and atom in one number. Moments are sums over members.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.functions.box import Box
from motefield.operators.components import connected_components

#: Atoms of a frame; frame * FRAME_SIZE + atom is a node.
FRAME_SIZE = 1 << 32


def clusters(pairs: DataFrame, atoms: DataFrame) -> DataFrame:
    """(frame, atom, cluster): the least atom reachable; atoms without neighbours are their own."""
    node = lambda c: F.col("frame").cast("long") * FRAME_SIZE + F.col(c)
    found = connected_components(pairs.select(node("i").alias("src"), node("j").alias("dst")))
    rows = atoms.select("frame", "atom", node("atom").alias("node"))
    return rows.join(found, "node", "left").select("frame", "atom", F.coalesce(F.pmod("component", F.lit(FRAME_SIZE)), "atom").alias("cluster"))


def cluster_sizes(members: DataFrame, min_size: int = 1) -> DataFrame:
    """(frame, cluster, size) of clusters of at least ``min_size``, a filter on what is told."""
    return members.groupBy("frame", "cluster").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)


def moments(rows: DataFrame, by, mass: Column | None = None) -> DataFrame:
    """(by, n, mass, cx.., mx.., gxx..gzz, ixx..izz, rg) of each group: geometric centre, centre
    of mass, gyration tensor about the first, inertia tensor and radius about the second. Without
    masses one aggregate gives all; with masses a first one gives a point to sum about."""
    xyz = ("x", "y", "z")
    cells = [(a, b) for i, a in enumerate(xyz) for b in xyz[i:]]
    held = rows.withColumn("_m", F.lit(1.0) if mass is None else mass)
    about = {c: F.col(c) for c in xyz}
    if mass is not None:  # sums about a point of the group: far from the origin raw ones would cancel
        by = list(by)
        first = held.groupBy(*by).agg(*[F.avg(c).alias(f"_o{c}") for c in xyz])
        held = held.join(first, by)
        about = {c: F.col(c) - F.col(f"_o{c}") for c in xyz}
    sums = held.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("_m").alias("mass"),
        *[F.avg(c).alias(f"c{c}") for c in xyz], *[(F.sum(F.col("_m") * F.col(c)) / F.sum("_m")).alias(f"m{c}") for c in xyz],
        *[F.covar_pop(a, b).alias(f"_g{a}{b}") for a, b in cells],
        *([] if mass is None else [(F.sum(F.col("_m") * about[a] * about[b]) - F.sum(F.col("_m") * about[a]) * F.sum(F.col("_m") * about[b]) / F.sum("_m")).alias(f"_i{a}{b}") for a, b in cells]),
    )
    out = {f"g{a}{b}": F.col(f"_g{a}{b}") for a, b in cells}
    second = {f"{a}{b}": F.col("n") * F.col(f"_g{a}{b}") if mass is None else F.col(f"_i{a}{b}") for a, b in cells}
    trace = second["xx"] + second["yy"] + second["zz"]
    out |= {f"i{a}{b}": (trace - second[f"{a}{b}"]) if a == b else -second[f"{a}{b}"] for a, b in cells}
    out["rg"] = F.sqrt(F.greatest(trace, F.lit(0.0)) / F.col("mass"))
    return sums.withColumns(out).drop(*[f"_{k}{a}{b}" for k in "gi" for a, b in cells])


def principal_values(g: str = "g") -> tuple[Column, Column, Column]:
    """Eigenvalues, rising, of the symmetric tensor in columns gxx..gzz, in closed form."""
    c = lambda ab: F.col(f"{g}{ab}")
    mean = (c("xx") + c("yy") + c("zz")) / 3
    xx, yy, zz = c("xx") - mean, c("yy") - mean, c("zz") - mean
    p = F.sqrt((xx**2 + yy**2 + zz**2 + 2 * (c("xy") ** 2 + c("xz") ** 2 + c("yz") ** 2)) / 6)
    det = xx * (yy * zz - c("yz") ** 2) - c("xy") * (c("xy") * zz - c("yz") * c("xz")) + c("xz") * (c("xy") * c("yz") - yy * c("xz"))
    turn = F.acos(F.least(F.greatest(F.when(p > 0, det / (2 * p**3)).otherwise(1.0), F.lit(-1.0)), F.lit(1.0))) / 3
    high, low = mean + 2 * p * F.cos(turn), mean + 2 * p * F.cos(turn + 2 * math.pi / 3)
    return low, 3 * mean - high - low, high


def shape_descriptors(tensors: DataFrame) -> DataFrame:
    """Asphericity, acylindricity and relative anisotropy of gyration tensors."""
    a, b, c = principal_values()
    total = a + b + c
    return tensors.withColumns({"asphericity": c - (a + b) / 2, "acylindricity": b - a, "kappa2": F.when(total > 0, 1 - 3 * (a * b + b * c + c * a) / total**2)})


def unwrap_to_seed(rows: DataFrame, by, box: Box, order: str = "atom") -> DataFrame:
    """Coordinates of each group's members as the images nearest to its first atom."""
    w = Window.partitionBy(*by).orderBy(order)
    seed = {c: F.first(c).over(w) for c in "xyz"}
    d = box.minimum_image(tuple(F.col(c) - seed[c] for c in "xyz"))
    return rows.withColumns({c: seed[c] + v for c, v in zip("xyz", d, strict=True)})


def pca(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, list[float]]:
    """Rows with pc1 and pc2, and the two variances: the covariance in one aggregate, its
    eigenvectors on the driver. Signs make each vector's largest component positive."""
    import numpy as np

    k = len(columns)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    row = rows.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"v{i}_{j}") for i, j in cells]).first()
    m = np.zeros((k, k))
    for i, j in cells:
        m[i, j] = m[j, i] = row[f"v{i}_{j}"]
    values, vectors = np.linalg.eigh(m)
    picks = [vectors[:, -1], vectors[:, -2]]
    picks = [v * np.sign(v[np.argmax(np.abs(v))]) for v in picks]
    project = lambda v: sum(((F.col(c) - row[f"a{i}"]) * float(v[i]) for i, c in enumerate(columns)), F.lit(0.0))
    return rows.withColumns({"pc1": project(picks[0]), "pc2": project(picks[1])}), [float(values[-1]), float(values[-2])]


def kmeans(rows: DataFrame, columns: list[str], k: int, max_iter: int = 100, seed: int = 0) -> DataFrame:
    """Rows with ``label`` by Lloyd's iterations of Spark's own clustering."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=columns, outputCol="_features").transform(rows)
    return KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="_features", predictionCol="label").fit(ready).transform(ready).drop("_features")
