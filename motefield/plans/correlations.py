"""Registered queries of correlations over the full range of lags, in whole numbers of hundredths."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.operators import fourier, fullrange, signal
from motefield.plans import views as V
from motefield.plans.registry import query, rounded

_WHOLE = f"{V.WALKS}, w AS MATERIALIZED (SELECT particle, frame, CAST(round(x * 100) AS BIGINT) AS x, CAST(round(v * 100) AS BIGINT) AS v FROM walks)"


def _walks(spark, d):
    hundredths = lambda c: F.round(F.col(c) * 100).cast("long").alias(c)
    return V.walks(spark, d).select("particle", "frame", hundredths("x"), hundredths("v"))


@query(f"WITH {_WHOLE} SELECT CAST(b.frame - a.frame AS BIGINT) AS lag, CAST(sum((b.x - a.x) * (b.x - a.x)) AS BIGINT) AS total, count(*) AS n FROM w a JOIN w b ON a.particle = b.particle AND b.frame >= a.frame GROUP BY 1")
def msd_full(spark, d):
    found = fullrange.msd_full(_walks(spark, d), ("x",))
    return found.select("lag", F.round(F.col("msd") * F.col("n")).cast("long").alias("total"), "n")


@query(f"WITH {_WHOLE} SELECT CAST(b.frame - a.frame AS BIGINT) AS lag, CAST(sum(b.v * a.v) AS BIGINT) AS total, count(*) AS n FROM w a JOIN w b ON a.particle = b.particle AND b.frame >= a.frame GROUP BY 1")
def acf_full(spark, d):
    """In blocks of 32 frames, so that a user's events are several."""
    found = fullrange.acf_full(_walks(spark, d), ("v",), block=32)
    return found.select("lag", F.round(F.col("acf") * F.col("n")).cast("long").alias("total"), "n")


@query(f"""WITH {V.SERIES}, s AS MATERIALIZED (SELECT frame, CAST(round(m * 100) AS BIGINT) AS m FROM series)
SELECT b.frame - a.frame AS lag, CAST(sum(b.m * a.m) AS BIGINT) AS total, count(*) AS n FROM s a JOIN s b ON b.frame >= a.frame GROUP BY 1""")
def series_acf_full(spark, d):
    """One series over all hours, whose missing hours are masked."""
    s = V.series(spark, d).select("frame", F.round(F.col("m") * 100).cast("long").alias("m"))
    found = fullrange.acf_full(s, ("m",), keys=(), block=256)
    return found.select("lag", F.round(F.col("acf") * F.col("n")).cast("long").alias("total"), "n")


_DAYS = "days AS MATERIALIZED (SELECT (date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 2579 + 2579) % 2579 AS k, count(*) AS n FROM orders GROUP BY 1)"


def _days(spark, d):
    """Orders by day in a circle of 2,579 days, so that none falls out of it."""
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return V.table(spark, d, "orders").groupBy(F.pmod(day, F.lit(2579)).alias("k")).agg(F.count("*").alias("n"))


@query(f"""WITH {_DAYS} SELECT a.k, round(a.k * 0.01::DOUBLE, 6) AS omega, round(1 + 0.04 / pi() * sum(b.k * 0.01::DOUBLE * b.n / (b.k * b.k * 0.0001::DOUBLE - a.k * a.k * 0.0001::DOUBLE)), 5) AS eps_real
FROM days a JOIN days b ON (a.k + b.k) % 2 = 1 GROUP BY a.k""")
def kramers_kronig(spark, d):
    """Orders a day as a loss; the SQL sums over all pairs of days."""
    loss = _days(spark, d).select("k", (F.col("k") * 0.01).alias("omega"), F.col("n").cast("double").alias("eps_imag"))
    return signal.kramers_kronig(loss).select("k", rounded("omega"), rounded("eps_real", 5))


@query(f"""WITH {_DAYS} SELECT CAST(j.range AS BIGINT) AS k, round(sum(n * cos(2 * pi() * ((k * j.range) % 2579) / 2579)), 4) + 0.0 AS re, round(sum(n * sin(2 * pi() * ((k * j.range) % 2579) / 2579)), 4) + 0.0 AS im
FROM days, range(2579) j GROUP BY 1""")
def days_transform(spark, d):
    """Orders a day transformed over 2,579 days, a prime, so by a chirp; the SQL sums each frequency."""
    points = _days(spark, d).select(F.col("k").alias("j"), F.col("n").cast("double").alias("re"), F.lit(0.0).alias("im"))
    return fourier.dft(points, 2579).select(F.col("j").alias("k"), rounded("re", 4), (F.round(-F.col("im"), 4) + 0.0).alias("im"))
