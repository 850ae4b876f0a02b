"""Histograms over fixed bins whose empty bins are rows too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(value: Column, n_bins: int, low: float, high: float) -> Column:
    """Bin of a value in [low, high), else null."""
    width = (high - low) / n_bins
    return F.when((value >= low) & (value < high), F.least(F.floor((value - low) / width), F.lit(n_bins - 1).cast("long")).cast("int"))


def histogram(df: DataFrame, value: Column, n_bins: int, low: float, high: float, weight: Column | None = None) -> DataFrame:
    """(bin, lo, hi, count, density): values outside the range drop out, density integrates to
    1 over what is counted (0 where nothing is)."""
    width = (high - low) / n_bins
    counts = df.select(bin_of(value, n_bins, low, high).alias("bin"), (F.lit(1) if weight is None else weight).alias("w")).where("bin is not null").groupBy("bin").agg(F.sum("w").alias("count"))
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    filled = bins.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))
    total = counts.agg(F.sum("count").alias("total"))  # one row
    return (
        filled.join(F.broadcast(total), F.lit(True), "left")
        .select("bin", (F.lit(low) + F.col("bin") * width).alias("lo"), (F.lit(low) + (F.col("bin") + 1) * width).alias("hi"), "count", F.coalesce(F.col("count") / F.col("total") / width, F.lit(0.0)).alias("density"))
    )


def histogram_nd(df: DataFrame, axes: list[tuple[str, Column, int, float, float]]) -> DataFrame:
    """Joint counts over (name, value, bins, low, high) axes; cells without counts are rows too."""
    named = df.select(*[bin_of(v, n, a, b).alias(name) for name, v, n, a, b in axes]).dropna()
    counts = named.groupBy(*[name for name, *_ in axes]).agg(F.count("*").alias("count"))
    grid = df.sparkSession.range(1)
    for name, _, n, _, _ in axes:
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.drop("id").join(counts, [name for name, *_ in axes], "left").fillna(0, ["count"])
