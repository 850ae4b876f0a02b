"""Running results of frames that arrive over time, as streaming aggregations.

Frames are files of atoms that appear in a folder. Their time column carries the watermark, so
the state of a window is dropped once frames can no longer fall into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.operators.histogram import bin_of


def read_frames(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """Parquet files of atoms as they are added to ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_histogram(rows: DataFrame, value: str, n_bins: int, low: float, high: float, time: str = "time", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, bin, count) of a value over windows of event time; what is out of range or has no
    value is left out, and so is what comes later than ``late``."""
    binned = rows.withWatermark(time, late).select(F.col(time), bin_of(F.col(value), n_bins, low, high).alias("bin")).where("bin is not null")
    return binned.groupBy(F.window(time, window).alias("window"), "bin").agg(F.count("*").alias("count"))


def running_moments(rows: DataFrame, weight: str, values, time: str = "time", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, n, and the sum of weight times each value) over windows of event time."""
    marked = rows.withWatermark(time, late)
    return marked.groupBy(F.window(time, window).alias("window")).agg(F.count("*").alias("n"), *[F.sum(F.col(weight) * F.col(v)).alias(v) for v in values])
