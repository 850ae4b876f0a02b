"""Frames in order: slices, segments by count, time or boundaries, zips of several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_slice(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, n_frames: int | None = None, frame: str = "frame") -> DataFrame:
    """Rows of frames [start:stop:step]; negative ends count from ``n_frames``."""
    if step < 1:
        raise ValueError("step must be positive")
    fix = lambda v: v if v is None or v >= 0 else max(0, v + n_frames)
    start, stop = fix(start) or 0, fix(stop)
    kept = df.where(F.col(frame) >= start)
    kept = kept.where(F.col(frame) < stop) if stop is not None else kept
    return kept.where(F.pmod(F.col(frame) - start, F.lit(step)) == 0) if step > 1 else kept


def split_by_frames(frames: DataFrame, every: int, frame: str = "frame") -> DataFrame:
    """``segment``: frames in runs of ``every``, the last shorter if need be."""
    return frames.withColumn("segment", F.floor(F.col(frame) / every).cast("int"))


def split_by_time(frames: DataFrame, interval: float, keys=(), frame: str = "frame", time: str = "time") -> DataFrame:
    """``segment``: a boundary at the first frame at or past the next multiple of ``interval``,
    one boundary a frame at most, so that a gap does not skip segments.

    With f the interval a frame's time lies in, the segment of the i-th frame is
    i + min(f - i) over the frames so far.
    """
    w = Window.partitionBy(*keys).orderBy(frame)
    row = F.row_number().over(w) - 1
    reached = F.floor((F.col(time) - F.first(time).over(w)) / interval)
    marked = frames.withColumn("_i", row).withColumn("_d", reached - F.col("_i"))
    return marked.withColumn("segment", (F.col("_i") + F.min("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("int")).drop("_i", "_d")


def split_at(frames: DataFrame, boundaries: DataFrame, keys=(), frame: str = "frame") -> DataFrame:
    """``segment``: the number of boundaries (their first column) up to and with the frame."""
    marks = boundaries.select(F.col(boundaries.columns[0]).alias(frame), F.lit(1).alias("_b")).distinct()
    w = Window.partitionBy(*keys).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    return frames.join(marks, frame, "left").withColumn("segment", (F.sum(F.coalesce("_b", F.lit(0))).over(w) - 1).cast("int")).drop("_b")


def zip_frames(*tables: DataFrame, frame: str = "frame") -> DataFrame:
    """Rows of several tables of one row a frame, side by side, as far as all go."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, frame)
    return out


def map_frames(df: DataFrame, step, schema: str, keys=("frame",)) -> DataFrame:
    """``step`` on each frame's rows as a pandas frame, in the order of the frames' own tasks: for
    what Columns can't say. A frame is one group, so it must fit in a task."""
    return df.groupBy(*keys).applyInPandas(step, schema)
