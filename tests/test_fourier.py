"""Transforms in two steps against those of whole curves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motefield.operators import fourier, signal


def told(rows, n):
    out = np.full(n, np.nan, dtype=complex)
    for r in rows.collect():
        assert np.isnan(out[r.j])
        out[r.j] = r.re + 1j * r.im
    return out


@pytest.mark.parametrize("n", [1, 2, 12, 97, 331, 360, 1024, 2579])
def test_dft(spark, n):
    rng = np.random.default_rng(n)
    at = np.flatnonzero(rng.random(n) < 0.7)
    at = at if len(at) else np.array([0])
    x = np.zeros(n, dtype=complex)
    x[at] = rng.standard_normal(len(at)) + 1j * rng.standard_normal(len(at))
    rows = spark.createDataFrame([(int(j), float(x[j].real), float(x[j].imag)) for j in at], "j long, re double, im double")
    assert np.allclose(told(fourier.dft(rows, n), n), np.fft.fft(x), atol=1e-9 * n)
    assert fourier.dft(rows.limit(0), n).count() == 0


def test_no_group_holds_the_curve(monkeypatch):
    """Groups are about the root of the points, for factors and for the chirp of a prime."""
    assert fourier._factor(1 << 20) == 1 << 10 and fourier._factor(360_000) == 600 and fourier._factor(1_000_003) == 1


def test_convolve(spark):
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal(20), rng.standard_normal(9)
    rows = lambda v: spark.createDataFrame([(k, float(x), 0.0) for k, x in enumerate(v)], "j long, re double, im double")
    got = told(fourier.convolve(rows(a), rows(b), 32), 32)
    assert np.allclose(got[:28], np.convolve(a, b)) and np.allclose(got[28:], 0, atol=1e-12)


def test_real_part_of_a_debye_process(spark):
    """The loss up to far frequencies gives the real part that belongs to it."""
    tau, strength, h = 40.0, 9.0, 0.001
    losses = spark.range(0, 40_000).select(F.col("id").cast("int").alias("k"), (F.col("id") * h).alias("omega")).withColumn("eps_imag", strength * F.col("omega") * tau / (1 + (F.col("omega") * tau) ** 2))
    for r in signal.kramers_kronig(losses, 1.5).where("k between 1 and 400").collect():
        assert r.eps_real == pytest.approx(1.5 + strength / (1 + (r.omega * tau) ** 2), abs=0.01)
    assert signal.kramers_kronig(losses.limit(0)).count() == 0


def test_both_ways_of_a_transform(spark, monkeypatch):
    curve = spark.range(90).select(F.col("id").cast("int").alias("lag"), F.when(F.col("id") != 7, F.sin(F.col("id") * 0.3)).alias("acf")).where("lag % 5 <> 4")
    direct = {r.k: (r.re, r.im) for r in signal.transform(curve, "acf", 80).collect()}
    monkeypatch.setattr(signal, "LONG", 8)
    fast = {r.k: (r.re, r.im) for r in signal.transform(curve.where("lag < 80"), "acf", 80).collect()}
    kept = {r.k: (r.re, r.im) for r in signal.transform(curve, "acf", 80).collect()}
    assert set(fast) == set(range(41)) == set(kept)
    assert all(math.isclose(a, b, abs_tol=1e-9) for k in fast for a, b in zip(fast[k], kept[k]))
    assert len(direct) == 41
