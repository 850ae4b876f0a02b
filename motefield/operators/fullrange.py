"""Correlations over the full range of lags by fast transforms, T log T for T frames of a particle.

A particle's frames are cut into blocks; a pair of blocks (low, high) gives all products of a frame of
the low one with a frame of the high one by lag, in one zero-padded transform of both. Each pair of blocks is
a group of its own, so no group holds more than two blocks, however long a series is; a series no longer than a
block is one group. Missing frames are masked: products and their number are transformed alike.

Squared displacements are products too: the sum of a^2 + b^2 - 2ab over the pairs of a lag is the squares
correlated with the mask both ways less twice the correlation of the values. Values are taken from their first in
the block pair, which squared displacements don't see, so large places far from 0 lose no digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frames in one block.
BLOCK = 65_536


def _transformed(rows: np.ndarray, size: int) -> np.ndarray:
    return np.fft.rfft(rows, size, axis=-1)


def _correlated(low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """Sums over t of low(t) high(t + s) for s from -(n - 1) to n - 1, n the blocks' length, by row."""
    n = low.shape[-1]
    both = np.fft.irfft(np.conj(_transformed(low, size)) * _transformed(high, size), size, axis=-1)
    return np.concatenate((both[..., size - n + 1 :], both[..., :n]), axis=-1)


def pair_sums(low: np.ndarray, low_at: np.ndarray, high: np.ndarray, high_at: np.ndarray, block: int, displacement: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sum, number) by shift of the pairs of a row of ``low`` and one of ``high``, at places ``low_at`` and
    ``high_at`` of blocks of ``block`` frames; the shifts go from 1 - block to block - 1."""
    size = 1 << (2 * block - 1).bit_length()
    origin = low[0] if displacement else np.zeros(low.shape[1])
    a, b = np.zeros((low.shape[1], block)), np.zeros((low.shape[1], block))
    ma, mb = np.zeros(block), np.zeros(block)
    a[:, low_at], b[:, high_at] = (low - origin).T, (high - origin).T
    ma[low_at] = mb[high_at] = 1.0
    number = np.rint(_correlated(ma, mb, size)).astype(np.int64)
    sums = _correlated(a, b, size).sum(axis=0)
    if displacement:
        sums = _correlated((a * a).sum(axis=0), mb, size) + _correlated(ma, (b * b).sum(axis=0), size) - 2 * sums
    return sums, number


def _by_lag(rows: DataFrame, values: list[str], keys: list[str], time: str, block: int, displacement: bool, max_lag: int | None) -> DataFrame:
    """(lag, total, n) over all keys."""
    if block < 1:
        raise ValueError("a block has one frame at least")
    given = rows.where(F.col(time).isNotNull()).select(*keys, F.floor(F.col(time) / block).alias("_b"), F.pmod(F.col(time), F.lit(block)).cast("int").alias("_at"), F.array(*[F.col(v).cast("double") for v in values]).alias("_v"))
    given = given.where(~F.exists("_v", lambda x: x.isNull()))
    # two numbers: how far blocks can be apart
    ends = given.agg(F.min("_b").alias("a"), F.max("_b").alias("b")).first()
    if ends["a"] is None:
        return rows.sparkSession.createDataFrame([], "lag long, total double, n long")
    apart = ends["b"] - ends["a"] if max_lag is None else min(ends["b"] - ends["a"], -(-max_lag // block))
    shift = F.sequence(F.lit(0).cast("long"), F.lit(apart).cast("long"))
    early = given.withColumn("_d", F.explode(shift)).withColumns({"_low": F.col("_b"), "_side": F.lit(0)})
    late = given.withColumn("_d", F.explode(shift)).withColumns({"_low": F.col("_b") - F.col("_d"), "_side": F.lit(1)})
    # a block with itself is sent once
    both = early.union(late.where("_d > 0")).where(F.col("_low").between(ends["a"], ends["b"]) & (F.col("_low") + F.col("_d") <= ends["b"]))

    def run(table: pa.Table) -> pa.Table:
        side, at = table.column("_side").to_numpy(), table.column("_at").to_numpy()
        shape = (len(at), len(values))
        value = np.asarray(table.column("_v").combine_chunks().flatten()).reshape(shape)
        apart = int(table.column("_d")[0].as_py())
        low = side == 0
        high = low if apart == 0 else ~low
        if not low.any() or not high.any():
            return pa.table({"lag": pa.array([], pa.int64()), "total": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        width = int(at.max()) + 1  # shorter series have shorter transforms
        sums, number = pair_sums(value[low], at[low], value[high], at[high], width, displacement)
        lag = apart * block + np.arange(1 - width, width)
        keep = (number > 0) & (lag >= 0) & ((lag <= max_lag) if max_lag is not None else True)
        return pa.table({"lag": lag[keep], "total": sums[keep], "n": number[keep]})

    found = both.groupBy(*keys, "_low", "_d").applyInArrow(run, "lag long, total double, n long")
    return found.groupBy("lag").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def msd_full(walks: DataFrame, values=("x", "y", "z"), keys=("particle",), time: str = "frame", block: int = BLOCK, max_lag: int | None = None) -> DataFrame:
    """(lag, msd, n): squared displacement over all origins and particles, at every lag that two frames have.

    The same as ``dynamics.msd_window`` where that is given the full range. Rows with a null value or time don't count; a
    particle has one row a frame. No rows give no lags.
    """
    return _by_lag(walks, list(values), list(keys), time, block, True, max_lag).select("lag", (F.col("total") / F.col("n")).alias("msd"), "n")


def acf_full(df: DataFrame, values, keys=("particle",), time: str = "frame", block: int = BLOCK, max_lag: int | None = None) -> DataFrame:
    """(lag, acf, n): mean dot product over particles and origins, at every lag; the same as ``dynamics.acf``.
    One series without particles has ``keys=()``."""
    return _by_lag(df, list(values), list(keys), time, block, False, max_lag).select("lag", (F.col("total") / F.col("n")).alias("acf"), "n")
