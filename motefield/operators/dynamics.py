"""Time correlations of particles and of collective series.

Lags are exploded on one side and joined on (particle, frame + lag): an equi-join on both
keys. Frames are consecutive integers; a lag whose frame is missing contributes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.functions.box import Box
from motefield.functions.geometry import legendre
from motefield.operators.histogram import bin_of
from motefield.operators.neighbors import cross_pairs


def lag_join(df: DataFrame, values: list[str], max_lag: int | None = None, lags: list[int] | None = None, keys=("particle",), time: str = "frame", stride: int = 1) -> DataFrame:
    """(keys, frame, lag, values, values_lag) of each row and the rows of later frames."""
    steps = F.sequence(F.lit(0), F.lit(max_lag)) if lags is None else F.array(*[F.lit(v) for v in lags])
    origin = df.where(F.col(time) % stride == 0) if stride > 1 else df
    early = origin.select(*keys, F.col(time).alias("_t0"), *[F.col(v).alias(v) for v in values]).withColumn("lag", F.explode(steps)).withColumn("_t", F.col("_t0") + F.col("lag"))
    late = df.select(*keys, F.col(time).alias("_t"), *[F.col(v).alias(f"{v}_lag") for v in values])
    return early.join(late, [*keys, "_t"]).select(*keys, F.col("_t0").alias(time), "lag", *values, *[f"{v}_lag" for v in values])


def _dot(a: list[str], b: list[str]) -> Column:
    return sum((F.col(p) * F.col(q) for p, q in zip(a, b, strict=True)), F.lit(0.0))


def _square(values: list[str]) -> Column:
    return sum(((F.col(f"{v}_lag") - F.col(v)) ** 2 for v in values), F.lit(0.0))


def msd_direct(walks: DataFrame, values=("x", "y", "z"), keys=("particle",)) -> DataFrame:
    """(frame, msd, n): squared displacement from each particle's first frame."""
    w = Window.partitionBy(*keys).orderBy("frame")
    moved = walks.select("frame", *[(F.col(v) - F.first(v).over(w)).alias(v) for v in values])
    return moved.groupBy("frame").agg(F.avg(sum((F.col(v) ** 2 for v in values), F.lit(0.0))).alias("msd"), F.count("*").alias("n"))


def msd_window(walks: DataFrame, max_lag: int, values=("x", "y", "z"), keys=("particle",)) -> DataFrame:
    """(lag, msd, n): squared displacement over all origins and particles."""
    values = list(values)
    return lag_join(walks, values, max_lag, keys=keys).groupBy("lag").agg(F.avg(_square(values)).alias("msd"), F.count("*").alias("n"))


def acf(df: DataFrame, values, max_lag: int, keys=("particle",)) -> DataFrame:
    """(lag, acf, n): mean dot product over particles and origins."""
    values = list(values)
    return lag_join(df, values, max_lag, keys=keys).groupBy("lag").agg(F.avg(_dot(values, [f"{v}_lag" for v in values])).alias("acf"), F.count("*").alias("n"))


def acf_sums(series: DataFrame, value: str, max_lag: int) -> DataFrame:
    """(lag, acf): sums of products of one series (frame, value), not divided."""
    return lag_join(series, [value], max_lag, keys=()).groupBy("lag").agg(F.sum(F.col(value) * F.col(f"{value}_lag")).alias("acf"))


def cross_displacement(series: DataFrame, a, b, max_lag: int) -> DataFrame:
    """(lag, value): mean product of the displacements of two collective series."""
    a, b = list(a), list(b)
    joined = lag_join(series, list(dict.fromkeys([*a, *b])), max_lag, keys=())
    step = sum(((F.col(f"{p}_lag") - F.col(p)) * (F.col(f"{q}_lag") - F.col(q)) for p, q in zip(a, b, strict=True)), F.lit(0.0))
    return joined.groupBy("lag").agg(F.avg(step).alias("value"), F.count("*").alias("n"))


def einstein_conductivity(series: DataFrame, values, max_lag: int, dt: float) -> DataFrame:
    """(lag, lag_time, msd) of a collective dipole."""
    return cross_displacement(series, values, values, max_lag).select("lag", (F.col("lag") * dt).alias("lag_time"), F.col("value").alias("msd"))


def green_kubo_conductivity(series: DataFrame, values, max_lag: int, dt: float) -> DataFrame:
    """(lag, lag_time, jacf) of a collective current."""
    return acf(series, values, max_lag, keys=()).select("lag", (F.col("lag") * dt).alias("lag_time"), F.col("acf").alias("jacf"))


def onsager(series: DataFrame, a, b, max_lag: int, dt: float) -> DataFrame:
    """(lag, lag_time, l): correlation of the displacements of two species' sums."""
    return cross_displacement(series, a, b, max_lag).select("lag", (F.col("lag") * dt).alias("lag_time"), F.col("value").alias("l"))


def collective(atoms: DataFrame, weight: str, values=("x", "y", "z"), by=("frame",)) -> DataFrame:
    """Sums of weight times value by frame: dipoles from charges, currents from velocities."""
    return atoms.groupBy(*by).agg(*[F.sum(F.col(weight) * F.col(v)).alias(v) for v in values])


def reorientation(vectors: DataFrame, max_lag: int, stride: int = 1, keys=("particle",)) -> DataFrame:
    """(lag, c1, c2): Legendre correlations of the directions (ux, uy, uz)."""
    u = ["ux", "uy", "uz"]
    size = F.sqrt(_dot(u, u))
    unit = vectors.select(*keys, "frame", *[(F.col(c) / size).alias(c) for c in u])
    cosine = _dot(u, [f"{c}_lag" for c in u])
    pairs = lag_join(unit, u, max_lag, keys=keys, stride=stride).select("lag", cosine.alias("c"))
    return pairs.groupBy("lag").agg(F.avg(legendre(1, F.col("c"))).alias("c1"), F.avg(legendre(2, F.col("c"))).alias("c2"), F.count("*").alias("n"))


def van_hove_self(walks: DataFrame, n_bins: int, r_max: float, lags: list[int], values=("x", "y", "z"), stride: int = 1, keys=("particle",)) -> DataFrame:
    """(lag, bin, count, g): displacement distribution at given lags; g integrates to the share
    within ``r_max``. Bins without counts are rows too."""
    values, width = list(values), r_max / n_bins
    moved = lag_join(walks, values, lags=lags, keys=keys, stride=stride).select("lag", F.sqrt(_square(values)).alias("r"))
    totals = moved.groupBy("lag").agg(F.count("*").alias("total"))
    counts = moved.select("lag", bin_of(F.col("r"), n_bins, 0.0, r_max).alias("bin")).where("bin is not null").groupBy("lag", "bin").agg(F.count("*").alias("count"))
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return grid.join(counts, ["lag", "bin"], "left").fillna(0, ["count"]).select("lag", "bin", "count", (F.col("count") / F.col("total") / width).alias("g"))


def van_hove_distinct(walks: DataFrame, box: Box, n_bins: int, r_max: float, lags: list[int]) -> DataFrame:
    """(lag, bin, count): other particles around where a particle was, ``lag`` frames later; a
    cell join between frames."""
    early = walks.withColumn("lag", F.explode(F.array(*[F.lit(v) for v in lags]))).withColumn("at", F.col("frame") + F.col("lag"))
    late = walks.withColumn("lag", F.explode(F.array(*[F.lit(v) for v in lags]))).withColumn("at", F.col("frame"))
    near = cross_pairs(early, late, box, r_max, keys=("lag", "at"), atom="particle").where("i <> j")
    return near.select("lag", bin_of(F.col("dist"), n_bins, 0.0, r_max).alias("bin")).where("bin is not null").groupBy("lag", "bin").agg(F.count("*").alias("count"))


def bonded_islands(distances: DataFrame, r0: float, r1: float) -> DataFrame:
    """(i, j, frame, island) while a pair is bonded: from a distance under ``r0`` on, until it
    exceeds ``r1`` or the pair is missing from a frame. ``distances``: (i, j, frame, dist)."""
    w = Window.partitionBy("i", "j").orderBy("frame")
    gone = F.coalesce(F.col("frame") - F.lag("frame").over(w) > 1, F.lit(True)) | (F.col("dist") > r1)
    marked = distances.withColumn("island", F.sum(gone.cast("int")).over(w))
    inside = Window.partitionBy("i", "j", "island").orderBy("frame")
    formed = F.max((F.col("dist") < r0).cast("int")).over(inside) == 1
    return marked.withColumn("_formed", formed).where((F.col("dist") <= r1) & F.col("_formed")).select("i", "j", "frame", "island")


def pair_survival(distances: DataFrame, n_i: int | None, n_frames: int | None, r0: float, r1: float, max_lag: int, continuous: bool = True) -> DataFrame:
    """(lag, c): bonded pairs per particle i that are bonded again, or without a break
    (``continuous``), ``lag`` frames later, over all origins. Numbers of particles and frames
    that are None are counted in ``distances``; c is null at lags that no two frames have."""
    bonded = bonded_islands(distances, r0, r1)
    keys = ["i", "j", "island"] if continuous else ["i", "j"]
    # an island has no missing frame: to be in the same island later is to have stayed bonded
    kept = lag_join(bonded.select(*keys, "frame"), [], max_lag, keys=keys).groupBy("lag").agg(F.count("*").alias("n"))
    lags = distances.sparkSession.range(max_lag + 1).select(F.col("id").cast("int").alias("lag"))
    found = lags.join(kept, "lag", "left").withColumns({"_i": F.lit(n_i), "_f": F.lit(n_frames)})
    for name, of, given in (("_i", "i", n_i), ("_f", "frame", n_frames)):
        if given is None:
            counted = distances.select(of).distinct().agg(F.count(of).alias(name))  # one row
            found = found.drop(name).join(F.broadcast(counted), F.lit(True))
    return found.select("lag", F.when(F.col("_f") > F.col("lag"), F.coalesce("n", F.lit(0)) / (F.col("_i") * (F.col("_f") - F.col("lag")))).alias("c"))


def linear_fit(curve: DataFrame, x: str, y: str, start: float = 0.0, stop: float = 1.0) -> DataFrame:
    """(slope, intercept, r2, n) of the part of a curve between two fractions of its points."""
    ranked = curve.withColumn("_k", F.row_number().over(Window.orderBy(x)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))  # a curve: as many rows as lags
    part = ranked.where((F.col("_k") >= F.floor(F.col("_n") * start)) & (F.col("_k") < F.ceil(F.col("_n") * stop)))
    return part.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))


def cumulative_trapezoid(curve: DataFrame, y: str, dt: float, order: str = "lag") -> DataFrame:
    """The curve with its running integral, 0 at the first point."""
    w = Window.orderBy(order)  # a curve
    return curve.withColumn("_s", F.coalesce((F.col(y) + F.lag(y).over(w)) * (dt / 2), F.lit(0.0))).withColumn("integral", F.sum("_s").over(w)).drop("_s")


def debye_fit(phi: DataFrame, y: str, dt: float, order: str = "lag") -> DataFrame:
    """(tau, amplitude, n_samples) of a decaying exponential, by a line through its logarithm."""
    points = phi.where(F.col(y) > 0).select((F.col(order) * dt).alias("t"), F.ln(y).alias("l"))
    return points.agg((-1 / F.regr_slope("l", "t")).alias("tau"), F.exp(F.regr_intercept("l", "t")).alias("amplitude"), F.count("*").alias("n_samples"))


def diffusion_einstein(msd: DataFrame, dt: float, dimensions: int = 3, start: float = 0.1, stop: float = 0.9) -> DataFrame:
    return linear_fit(msd.withColumn("_t", F.col("lag") * dt), "_t", "msd", start, stop).withColumn("diffusion", F.col("slope") / (2 * dimensions))


def diffusion_green_kubo(vacf: DataFrame, dt: float, dimensions: int = 3) -> DataFrame:
    return cumulative_trapezoid(vacf, "acf", dt).withColumn("diffusion", F.col("integral") / dimensions)


#: Vacuum permittivity in e^2/(J Angstrom), and the Boltzmann constant in J/K.
EPS0, BOLTZMANN = 8.8541878128e-12 / 1.602176634e-19**2 * 1e-10, 1.380649e-23


def static_dielectric(dipoles: DataFrame, values, volume: float, temperature: float, eps_inf: float = 1.0) -> DataFrame:
    """eps_inf plus the fluctuation of the total dipole over 3 eps0 V k T."""
    total = sum((F.var_pop(v) for v in values), F.lit(0.0))
    return dipoles.agg(total.alias("variance")).select("variance", (eps_inf + F.col("variance") / (3 * EPS0 * volume * BOLTZMANN * temperature)).alias("epsilon"))


def dipole_strength(variance: float, volume: float, temperature: float) -> float:
    """What a dipole's variance adds to the static permittivity."""
    return variance / (3 * EPS0 * volume * BOLTZMANN * temperature)


def debye_relaxation(dipoles: DataFrame, values, max_lag: int, keys=()) -> DataFrame:
    """(lag, acf, n, phi, zero_lag_variance) of the fluctuation of the total dipole about its
    mean; ``phi`` is the curve over its first point."""
    values = list(values)
    means = dipoles.agg(*[F.avg(v).alias(f"_m{v}") for v in values])  # one row
    moved = dipoles.join(F.broadcast(means), F.lit(True)).withColumns({v: F.col(v) - F.col(f"_m{v}") for v in values})
    curve = acf(moved, values, max_lag, keys=())
    first = curve.where("lag = 0").select(F.col("acf").alias("zero_lag_variance"))  # one row
    return curve.join(F.broadcast(first), F.lit(True)).withColumn("phi", F.col("acf") / F.col("zero_lag_variance"))


def current_density(dipoles: DataFrame, values, dt: float, volume: float, frame: str = "frame") -> DataFrame:
    """(frame, values): central differences of the total dipole over the volume, one-sided at
    the ends; neighbours in time come by equi-joins."""
    values = list(values)
    held = dipoles.select(frame, *values)
    near = lambda step: held.select((F.col(frame) - step).alias(frame), *[F.col(v).alias(f"_{v}{'a' if step > 0 else 'b'}") for v in values])
    joined = held.join(near(1), frame, "left").join(near(-1), frame, "left")

    def rate(v: str) -> Column:
        a, b = F.col(f"_{v}a"), F.col(f"_{v}b")
        steps = F.when(a.isNull() | b.isNull(), 1.0).otherwise(2.0)
        return ((F.coalesce(a, F.col(v)) - F.coalesce(b, F.col(v))) / (steps * dt * volume)).alias(v)

    return joined.select(frame, *[rate(v) for v in values])


def split_dipole(atoms: DataFrame, mask: Column, weight: str = "charge", values=("x", "y", "z"), by=("frame",)) -> DataFrame:
    """(by, x_in, ..., x_out, ...): the dipole of the atoms of a mask and of all others, in one
    aggregate."""
    terms = [F.sum(F.when(F.coalesce(mask, F.lit(False)) == side, F.col(weight) * F.col(v)).otherwise(0.0)).alias(f"{v}_{name}") for side, name in ((True, "in"), (False, "out")) for v in values]
    return atoms.groupBy(*by).agg(*terms)
