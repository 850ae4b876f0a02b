"""Windows, frequency grids and spectra of correlation curves.

A curve has as many rows as lags. A transform explodes each lag into the frequencies and sums
by frequency; beyond ``LONG`` lags, where that would be very many rows, it is a fast Fourier
transform in two steps of groups (``fourier.dft``), none of which holds the curve.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.operators.fourier import convolve, dft

#: Lags from which on a transform is a fast one; the sums are the same.
LONG = 4096

#: Fixed value: the speed of light in cm/fs.
LIGHT = 2.99792458e-5


def window_weight(kind: str, index: Column, n: int) -> Column:
    """Symmetric window of n points, zero at both ends: ``hann`` or ``blackman``."""
    if kind not in ("hann", "blackman"):
        raise ValueError(f"no window is called {kind}")
    turn = index * (2 * math.pi / max(n - 1, 1))
    if kind == "hann":
        return 0.5 - 0.5 * F.cos(turn)
    return 0.42 - 0.5 * F.cos(turn) + 0.08 * F.cos(2 * turn)


def apply_window(series: DataFrame, value: str, kind: str, n: int, order: str = "frame") -> DataFrame:
    """The series of n points, counted from 0 in ``order``, times the window."""
    return series.withColumn(value, F.col(value) * window_weight(kind, F.col(order), n))


def angular_frequency(k: Column, n: int, dt: float) -> Column:
    """2 pi k / (n dt): the grid of a real transform has k from 0 to n // 2."""
    return k * (2 * math.pi / (n * dt))


def transform(curve: DataFrame, value: str, n: int, order: str = "lag") -> DataFrame:
    """(k, re, im): sums of value cos(omega t) and value sin(omega t) over the points of a curve,
    at k = 0 ... n // 2 of a grid of n. Points that the curve lacks count as 0."""
    if n > LONG:
        points = curve.where((F.col(order) >= 0) & (F.col(order) < n)).select(F.col(order).cast("long").alias("j"), F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im"))
        return dft(points.fillna(0.0, ["re"]), n).where(F.col("j") <= n // 2).select(F.col("j").cast("int").alias("k"), "re", (-F.col("im")).alias("im"))
    rows = curve.select(F.col(order).alias("_l"), F.col(value).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("k"))
    turn = F.col("k") * F.col("_l") * (2 * math.pi / n)
    return rows.groupBy("k").agg(F.sum(F.col("_v") * F.cos(turn)).alias("re"), F.sum(F.col("_v") * F.sin(turn)).alias("im"))


def power_spectrum(curve: DataFrame, value: str, n: int, dt: float, order: str = "lag") -> DataFrame:
    """(k, omega, wavenumber, intensity) of a correlation curve of ``n`` lags ``dt`` fs apart:
    2 dt sum of value cos(omega t), lag 0 counted half. The wavenumber is in 1/cm."""
    halved = curve.withColumn(value, F.col(value) * F.when(F.col(order) == 0, 0.5).otherwise(1.0))
    omega = angular_frequency(F.col("k"), n, dt)
    return transform(halved, value, n, order).select("k", omega.alias("omega"), (omega / (2 * math.pi * LIGHT)).alias("wavenumber"), (F.col("re") * (2 * dt)).alias("intensity"))


def ir_spectrum(flux_acf: DataFrame, n: int, dt: float, value: str = "acf") -> DataFrame:
    """The power spectrum of the autocorrelation of the dipole flux."""
    return power_spectrum(flux_acf, value, n, dt)


def vcd_spectrum(cross_acf: DataFrame, n: int, dt: float, value: str = "acf") -> DataFrame:
    """The signed spectrum of the correlation of the electric with the magnetic dipole flux."""
    return power_spectrum(cross_acf, value, n, dt)


#: Fixed value: the reduced Planck constant over the Boltzmann constant, in K fs.
HBAR_OVER_K = 7638.2325


def scattering(omega: Column, laser: float | None, temperature: float | None) -> Column:
    """What scattering by light of the wavenumber ``laser`` at ``temperature`` multiplies an
    intensity by: (laser - wavenumber)^4 / laser^4 and the thermal factor
    x / (1 - exp(-x)) of x = hbar omega / k T. Left out where they are not given."""
    out = F.lit(1.0)
    if laser is not None:
        out = out * F.pow(1 - omega / (2 * math.pi * LIGHT) / laser, 4)
    if temperature is not None:
        x = omega * (HBAR_OVER_K / temperature)
        out = out * F.when(x < 1e-9, 1.0).otherwise(x / (1 - F.exp(-F.greatest(x, F.lit(1e-9)))))
    return out


def raman_spectrum(isotropic: DataFrame, anisotropic: DataFrame, n: int, dt: float, laser: float | None = None, temperature: float | None = None, value: str = "acf") -> DataFrame:
    """(k, omega, wavenumber, isotropic, anisotropic, parallel, perpendicular) from the curves
    of the mean polarizability and of its anisotropy. A resonant polarizability gives the
    resonance spectrum by the same transform."""
    one = power_spectrum(isotropic, value, n, dt)
    two = power_spectrum(anisotropic, value, n, dt).select("k", F.col("intensity").alias("other"))
    factor = scattering(F.col("omega"), laser, temperature)
    both = one.join(two, "k").select("k", "omega", "wavenumber", (F.col("intensity") * factor).alias("isotropic"), (F.col("other") * factor).alias("anisotropic"))
    parallel, perpendicular = raman_intensities(F.col("isotropic"), F.col("anisotropic"))
    return both.withColumns({"parallel": parallel, "perpendicular": perpendicular})


def roa_spectrum(isotropic: DataFrame, anisotropic: DataFrame, n: int, dt: float, laser: float | None = None, temperature: float | None = None, averaged: bool = False, value: str = "acf") -> DataFrame:
    """(k, omega, wavenumber, isotropic, anisotropic, intensity), signed: backscattered circular
    intensity differences are 96 parts of the anisotropic invariant; ``averaged`` over all
    directions they are 180 of the isotropic and 40 of the anisotropic one, each over 90."""
    both = raman_spectrum(isotropic, anisotropic, n, dt, laser, temperature, value).drop("parallel", "perpendicular")
    told = (F.col("isotropic") * 180 + F.col("anisotropic") * 40) / 90 if averaged else F.col("anisotropic") * (96 / 90)
    return both.withColumn("intensity", told)


def _slope(value: str, dt: float, order: str) -> Column:
    """Central differences, one-sided at the ends; a window over a curve."""
    w = Window.orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    steps = F.when(before.isNull() | after.isNull(), 1.0).otherwise(2.0)
    return (F.coalesce(after, F.col(value)) - F.coalesce(before, F.col(value))) / (steps * dt)


def _trapezoid_ends(order: str, n: int) -> Column:
    return F.when((F.col(order) == 0) | (F.col(order) == n - 1), 0.5).otherwise(1.0)


def einstein_helfand_spectrum(curve: DataFrame, n: int, dt: float, strength: float, eps_inf: float = 1.0, value: str = "acf", order: str = "lag") -> DataFrame:
    """(k, omega, eps_real, eps_imag): eps_inf + strength x the transform of minus the slope of
    the normalised dipole correlation. ``strength`` is the static eps - eps_inf, that is the
    dipole's variance over 3 eps0 V k T."""
    first = curve.where(F.col(order) == 0).select(F.col(value).alias("_first"))  # one row
    scaled = curve.join(F.broadcast(first), F.lit(True)).withColumn("_phi", F.col(value) / F.col("_first"))
    steep = scaled.withColumn("_d", -_slope("_phi", dt, order) * _trapezoid_ends(order, n) * dt)
    omega = angular_frequency(F.col("k"), n, dt)
    return transform(steep, "_d", n, order).select("k", omega.alias("omega"), (eps_inf + strength * F.col("re")).alias("eps_real"), (strength * F.col("im")).alias("eps_imag"))


def green_kubo_spectrum(curve: DataFrame, n: int, dt: float, scale: float, eps_inf: float = 1.0, value: str = "acf", order: str = "lag") -> DataFrame:
    """(k, omega, eps_real, eps_imag) from the correlation of the current density: its one-sided
    transform times ``scale``, which is V / (3 eps0 k T), is i omega (eps - eps_inf). The grid's
    zero, where that says nothing, is left out."""
    weighted = curve.withColumn("_w", F.col(value) * _trapezoid_ends(order, n) * dt)
    omega = angular_frequency(F.col("k"), n, dt)
    rows = transform(weighted, "_w", n, order).where("k > 0").withColumn("omega", omega)
    return rows.select("k", "omega", (eps_inf - scale * F.col("im") / F.col("omega")).alias("eps_real"), (scale * F.col("re") / F.col("omega")).alias("eps_imag"))


def kramers_kronig(spectrum: DataFrame, eps_inf: float = 1.0) -> DataFrame:
    """(k, omega, eps_real) that the loss of a spectrum (k, omega, eps_imag) implies, by
    Maclaurin's rule: 4 h / pi times the sum over points of the other parity of
    w' eps_imag(w') / (w'^2 - w^2). ``omega`` is k times a step h, k not negative and each
    once; a point that the spectrum lacks or that is null counts as 0.

    With the loss as an odd function of k the sum is a convolution with 1 / m at odd m, so it
    is made of transforms whose groups hold about the root of the points. No rows give none."""
    rows = spectrum.select("k", "omega", "eps_imag")
    top = rows.agg(F.max("k")).first()[0]
    if top is None:
        return rows.select("k", "omega", F.lit(None).cast("double").alias("eps_real"))
    loss = rows.select(F.col("k").cast("long").alias("j"), F.coalesce("eps_imag", F.lit(0.0)).cast("double").alias("e")).where("j > 0")
    odd = loss.select(F.explode(F.array(F.struct("j", F.col("e").alias("re")), F.struct((-F.col("j")).alias("j"), (-F.col("e")).alias("re")))).alias("v")).select("v.j", "v.re", F.lit(0.0).alias("im"))
    # as long as the farthest two points are apart, to either side
    reach = 2 * int(top) + 1
    kernel = spectrum.sparkSession.range(-reach, reach + 1, 2).select(F.col("id").alias("j"), (-1.0 / F.col("id")).alias("re"), F.lit(0.0).alias("im"))
    sums = convolve(odd, kernel, 1 << (2 * reach).bit_length())
    return rows.join(sums.select(F.col("j").alias("k"), F.col("re").alias("_s")), "k").select("k", "omega", (eps_inf + F.col("_s") * (2 / math.pi)).alias("eps_real"))


def conductivity_sum_rule(spectrum: DataFrame, value: str = "sigma") -> DataFrame:
    """(total): the trapezoid of a conductivity over omega, which is pi/2 times the plasma
    frequency squared and eps0."""
    w = Window.orderBy("omega")  # a spectrum
    part = (F.col(value) + F.lag(value).over(w)) / 2 * (F.col("omega") - F.lag("omega").over(w))
    return spectrum.select(part.alias("p")).agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("total"))


def plateau(curve: DataFrame, y: str, start: float = 0.5, stop: float = 1.0, order: str = "lag") -> DataFrame:
    """(value, spread, n): mean and deviation of a curve between two fractions of its points."""
    w = Window.partitionBy()  # a curve
    ranked = curve.withColumn("_k", F.row_number().over(Window.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    part = ranked.where((F.col("_k") >= F.floor(F.col("_n") * start)) & (F.col("_k") < F.ceil(F.col("_n") * stop)))
    return part.agg(F.avg(y).alias("value"), F.stddev_pop(y).alias("spread"), F.count("*").alias("n"))


def raman_intensities(isotropic: Column, anisotropic: Column) -> tuple[Column, Column]:
    """(parallel, perpendicular) of the invariants: a^2 + 4/45 g^2 and g^2/15."""
    return isotropic + anisotropic * (4 / 45), anisotropic / 15


def fit_debye(spectrum: DataFrame, eps_inf: float = 1.0) -> DataFrame:
    """(tau, omega_peak) of (omega, eps_real, eps_imag): the slope through the origin of
    eps_imag / (eps_real - eps_inf) over omega up to the loss peak; 1 / omega_peak where no
    point remains."""
    peak = spectrum.where("omega > 0").agg(F.max_by("omega", "eps_imag").alias("omega_peak"))  # one row
    below = F.col("eps_real") - eps_inf
    used = F.col("omega").between(0, F.col("omega_peak")) & (F.col("omega") > 0) & (below != 0)
    rows = spectrum.join(F.broadcast(peak), F.lit(True))
    slope = F.sum(F.when(used, F.col("omega") * F.col("eps_imag") / below)) / F.sum(F.when(used, F.col("omega") ** 2))
    return rows.groupBy("omega_peak").agg(slope.alias("_s")).select(F.coalesce("_s", 1 / F.col("omega_peak")).alias("tau"), "omega_peak")
