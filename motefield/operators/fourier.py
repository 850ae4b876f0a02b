"""Discrete Fourier transforms of curves that no task holds whole.

A transform of n = p q points is q transforms of p points, a turn of each result, and p
transforms of q points: two groupings, each into groups of about the root of n. A length
without such factors is a convolution with a chirp, and convolutions are transforms of a power
of two. All work on (j, re, im) rows; points that are missing count as 0, repeated ones add up.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much larger than the root of n a group may be before a chirp is taken instead.
UNEVEN = 16


def _groups(rows: DataFrame, size: int, turn: int | None) -> DataFrame:
    """(g, at, re, im) of the transform of each group g over ``at``; with ``turn`` each value is
    turned by g at / turn of a circle."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g, x = int(group["g"].iloc[0]), np.zeros(size, dtype=complex)
        np.add.at(x, group["at"].to_numpy(), group["re"].to_numpy() + 1j * group["im"].to_numpy())
        y, at = np.fft.fft(x), np.arange(size)
        if turn:
            y *= np.exp(-2j * np.pi * ((g * at) % turn) / turn)
        return pd.DataFrame({"g": g, "at": at, "re": y.real, "im": y.imag})

    return rows.groupBy("g").applyInPandas(run, "g long, at long, re double, im double")


def _factor(n: int) -> int:
    """The largest divisor of n up to its root."""
    return next(p for p in range(math.isqrt(n), 0, -1) if n % p == 0)


def _by_factors(rows: DataFrame, n: int, p: int) -> DataFrame:
    q = n // p
    first = _groups(rows.select((F.col("j") % q).alias("g"), F.floor(F.col("j") / q).alias("at"), "re", "im"), p, n)
    second = _groups(first.select(F.col("at").alias("g"), F.col("g").alias("at"), "re", "im"), q, None)
    return second.select((F.col("g") + F.col("at") * p).alias("j"), "re", "im")


def _times(a: DataFrame, b: DataFrame) -> DataFrame:
    """Products at each j of two transforms; a j stands once in either."""
    other = b.select("j", F.col("re").alias("_re"), F.col("im").alias("_im"))
    return a.join(other, "j").select("j", (F.col("re") * F.col("_re") - F.col("im") * F.col("_im")).alias("re"), (F.col("re") * F.col("_im") + F.col("im") * F.col("_re")).alias("im"))


def convolve(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """(j, re, im): sums of a(i) b(j - i), places taken modulo ``size``, a power of two."""
    p = 1 << (size.bit_length() // 2)
    both = [_by_factors(x.withColumn("j", F.pmod("j", F.lit(size).cast("long"))), size, min(p, size)) for x in (a, b)]
    # the inverse is the transform of conjugates, conjugated
    back = _by_factors(_times(*both).withColumn("im", -F.col("im")), size, min(p, size))
    return back.select("j", (F.col("re") / size).alias("re"), (-F.col("im") / size).alias("im"))


def _chirp(rows: DataFrame, n: int, sign: int) -> tuple[Column, Column]:
    """cos and sin of sign pi j^2 / n, with j^2 taken modulo 2 n first."""
    angle = F.pmod(F.col("j") * F.col("j"), F.lit(2 * n).cast("long")) * (sign * math.pi / n)
    return F.cos(angle), F.sin(angle)


def _turned(rows: DataFrame, n: int) -> DataFrame:
    c, s = _chirp(rows, n, -1)
    return rows.select("j", (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im"))


def dft(rows: DataFrame, n: int) -> DataFrame:
    """(j, re, im): sums of x(i) exp(-2 pi i j / n) for j = 0 ... n - 1, of rows (j, re, im) with
    0 <= j < n. No rows give no rows."""
    p = _factor(n)
    if n // p <= UNEVEN * math.isqrt(n):
        return _by_factors(rows, n, p)
    size = 1 << (2 * n - 1).bit_length()
    ends = rows.sparkSession.range(1 - n, n).select(F.col("id").alias("j"))
    c, s = _chirp(ends, n, 1)
    met = convolve(_turned(rows, n), ends.select("j", c.alias("re"), s.alias("im")), size)
    return _turned(met.where(F.col("j") < n), n)
