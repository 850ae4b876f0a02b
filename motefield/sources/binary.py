"""Binary trajectories (DCD, TRR, XTC) by frame ranges.

An index comes first: a row per frame with its place in the file. A DCD file's frames are of one size, so its
header tells them all; the other files are walked from header to header, each range of bytes by a task of its
own, which finds the first frame that begins in its range. Frames are then read by place, some at a time, by as
many tasks as their bytes ask for. A condition on frames is a condition on the index: frames that it
leaves out are never read, and a file may be larger than one record of Spark's or one task's memory.

Lengths are in Angstrom. Files are listed by Spark and opened by tasks, through the file system that their address
names; a path without one must lie in a folder that all executors share. A file that breaks off gives the frames before.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motefield.sources.xtc import decode_positions
from motefield.storage import materialize

SCHEMA = "file string, frame long, time double, cell array<double>, atom long, x double, y double, z double"
#: Bytes that a task walks or reads; bytes that are searched at once.
RANGE, STEP = 64 << 20, 1 << 20
#: What a frame of each format begins with.
TRR_MARK = struct.pack(">3i", 1993, 13, 12) + b"GMX_trn_file"
XTC_MARKS = (struct.pack(">i", 1995), struct.pack(">i", 2023))

Parsed = tuple[float, list[float] | None, np.ndarray]


def _open(address: str):
    if address.startswith("file:"):
        address = "/" + address[5:].lstrip("/")
    system, path = fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)
    return system.open_input_file(path)


# --- DCD -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class DcdHeader:
    order: str
    n: int
    start: int
    every: int
    step: float
    boxed: bool
    size: int

    @property
    def frame(self) -> int:
        return (56 if self.boxed else 0) + 3 * (4 * self.n + 8)


def dcd_header(read: Callable[[int, int], bytes]) -> DcdHeader:
    """From the three records at the beginning; ``read(at, size)`` gives bytes of the file."""
    order = "<" if read(0, 4) == struct.pack("<i", 84) else ">"
    control = read(4, 84)
    if control[:4] != b"CORD":
        raise ValueError("no DCD file")
    numbers = struct.unpack(order + "9i f 10i", control[4:])
    at = 92
    at += struct.unpack(order + "i", read(at, 4))[0] + 8
    n = struct.unpack(order + "i", read(at + 4, 4))[0]
    return DcdHeader(order, n, numbers[1], max(numbers[2], 1), numbers[9], bool(numbers[10]), at + 12)


def dcd_frame(raw: bytes, header: DcdHeader, frame: int) -> Parsed:
    """``cell`` is A, gamma, B, beta, alpha, C as stored, or None; the time is in steps times the step's length."""
    at, cell = 0, None
    if header.boxed:
        cell, at = list(struct.unpack_from(header.order + "6d", raw, 4)), 56
    parts = [np.frombuffer(raw, dtype=header.order + "f4", count=header.n, offset=at + 4 + k * (4 * header.n + 8)) for k in range(3)]
    return float((header.start + frame * header.every) * header.step), cell, np.stack(parts, axis=1).astype(float)


def _dcd_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, first, bytes, frames) of (file, length)."""
    for batch in batches:
        rows = []
        for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with _open(name) as f:
                header = dcd_header(lambda at, size, f=f: f.read_at(size, at))
            rows.append((name, header.size, header.frame, max(0, length - header.size) // header.frame))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["file", "first", "bytes", "frames"])


# --- TRR and XTC -----------------------------------------------------------------------------


def trr_sizes(head: bytes) -> tuple[int, bool, int, int, int, int, int]:
    """(bytes of the frame, double precision, header's end, bytes of box, of what is before positions, of positions, atoms)."""
    _, _, length = struct.unpack_from(">3i", head, 0)
    at = 12 + (length + 3) // 4 * 4
    sizes = struct.unpack_from(">10i", head, at)
    n = struct.unpack_from(">i", head, at + 40)[0]
    box, x, v, f = sizes[2], sizes[7], sizes[8], sizes[9]
    some = x or v or f
    wide = (box // 9 if box else some // (3 * n) if some else 4) == 8
    end = at + 52 + (16 if wide else 8)
    return end + sum(sizes[2:5]) + x + v + f, wide, end, box, sum(sizes[2:5]), x, n


def trr_frame(raw: bytes) -> Parsed:
    """``cell`` holds the nine numbers of the box, or None."""
    _, wide, end, box, before, _, n = trr_sizes(raw)
    kind, width = (">f8", 16) if wide else (">f4", 8)
    time = struct.unpack_from(">d" if wide else ">f", raw, end - width)[0]
    cell = (np.frombuffer(raw, dtype=kind, count=9, offset=end) * 10.0).tolist() if box else None
    return float(time), cell, np.frombuffer(raw, dtype=kind, count=3 * n, offset=end + before).reshape(n, 3).astype(float) * 10


def xtc_size(head: bytes) -> int:
    """Bytes of the frame; small frames are stored plainly."""
    magic, n = struct.unpack_from(">2i", head, 0)
    if n <= 9:
        return 56 + 12 * n
    wide = magic == 2023
    size = struct.unpack_from(">q" if wide else ">i", head, 88)[0]
    return (96 if wide else 92) + (size + 3) // 4 * 4


def xtc_frame(raw: bytes) -> Parsed:
    """``cell`` holds the nine numbers of the box."""
    magic, n = struct.unpack_from(">2i", raw, 0)
    time = struct.unpack_from(">f", raw, 12)[0]
    cell = (np.frombuffer(raw, dtype=">f4", count=9, offset=16) * 10.0).astype(float).tolist()
    if n <= 9:
        return float(time), cell, np.frombuffer(raw, dtype=">f4", count=3 * n, offset=56).reshape(n, 3).astype(float) * 10
    precision = struct.unpack_from(">f", raw, 56)[0]
    low, high = (np.array(struct.unpack_from(">3i", raw, at), dtype=np.int64) for at in (60, 72))
    small = struct.unpack_from(">i", raw, 84)[0]
    whole = decode_positions(raw[96 if magic == 2023 else 92 :], n, low, high, small)
    return float(time), cell, whole * (10.0 / precision)


class _Walker:
    """Steps from frame to frame of an open TRR or XTC file."""

    def __init__(self, kind: str, file, length: int):
        self.kind, self.file, self.length = kind, file, length
        head = file.read_at(8, 0)
        self.n = struct.unpack(">i", head[4:])[0] if kind == "xtc" and len(head) == 8 else 0

    def size(self, at: int) -> tuple[int, bool]:
        """(bytes of the frame at a place, whether it has positions); 0 where no whole frame is."""
        head = self.file.read_at(256, at)
        if not self.begins(head):
            return 0, False
        try:
            size, some = (xtc_size(head), True) if self.kind == "xtc" else ((found := trr_sizes(head))[0], found[5] > 0)
        except struct.error:
            return 0, False
        return (size, some) if size > 0 and at + size <= self.length else (0, False)

    def begins(self, head: bytes) -> bool:
        if self.kind == "trr":
            return head[:24] == TRR_MARK
        # the number of atoms stands twice, with plausible fields between
        return head[:4] in XTC_MARKS and len(head) >= 56 and struct.unpack_from(">i", head, 4)[0] == self.n == struct.unpack_from(">i", head, 52)[0]

    def first(self, start: int, end: int) -> int:
        """The first place from ``start`` on where a frame begins that another or the file's end follows; ``end`` if there is none."""
        marks = (TRR_MARK,) if self.kind == "trr" else XTC_MARKS
        at = start
        while at < end:
            raw = self.file.read_at(STEP + 64, at)
            spots = sorted(at + i for mark in marks for i in _places(raw, mark) if i < STEP and (at + i) % 4 == 0)
            for spot in spots:
                if spot >= end:
                    return end
                size, _ = self.size(spot)
                if size and (spot + size == self.length or self.begins(self.file.read_at(256, spot + size)) or spot + size + 256 > self.length):
                    return spot
            at += STEP
        return end


def _places(raw: bytes, mark: bytes) -> Iterator[int]:
    at = raw.find(mark)
    while at >= 0:
        yield at
        at = raw.find(mark, at + 1)


def _walk(kind: str):
    """(file, start, k, offset, bytes) of the frames that begin in ranges (file, length, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places, sizes = [], []
                with _open(name) as f:
                    walker = _Walker(kind, f, length)
                    at = walker.first(start, end) if start else 0
                    while at < end:
                        size, some = walker.size(at)
                        if not size:
                            if not start and not at:
                                if not walker.begins(f.read_at(256, 0)):
                                    raise ValueError(f"no {kind.upper()} file: {name}")
                            break
                        if some:
                            places.append(at)
                            sizes.append(size)
                        at += size
                n = len(places)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(np.arange(n)), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], ["file", "start", "k", "offset", "bytes"])

    return run


# --- the index and what is read by it --------------------------------------------------------


def frame_index(spark: SparkSession, path, kind: str, range_bytes: int = RANGE) -> DataFrame:
    """(file, frame, frames, offset, bytes) of every frame with positions, written; ``kind``: dcd, trr or xtc.

    Frames count from 0 in each file, ``frames`` is their number there.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length"))
    if kind == "dcd":
        each = files.mapInArrow(_dcd_files, "file string, first long, bytes long, frames long").where("frames > 0")
        rows = each.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)).alias("frame"), "frames", "first", "bytes")
        return materialize(rows.select("file", "frame", "frames", (F.col("first") + F.col("frame") * F.col("bytes")).alias("offset"), "bytes"), "frames")
    if kind not in ("trr", "xtc"):
        raise ValueError(f"no trajectory format is called {kind}")
    ranges = files.where("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.least("length", F.col("start") + range_bytes))
    # as many tasks as ranges, so one large file is walked by many
    n = max(1, ranges.count())
    walked = materialize(ranges.repartition(min(n, 10_000), "file", "start").mapInArrow(_walk(kind), "file string, start long, k long, offset long, bytes long"), "walked")
    counts = walked.groupBy("file", "start").agg(F.count("*").alias("n"))
    w = Window.partitionBy("file").orderBy("start")
    before = counts.select("file", "start", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("file")).alias("frames"))
    rows = walked.join(materialize(before, "before"), ["file", "start"])
    return materialize(rows.select("file", (F.col("before") + F.col("k")).alias("frame"), "frames", "offset", "bytes"), "frames")


def frame_slice(index: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """The index rows of ``[start:stop:step]`` in each file; negative numbers count from its end. ``step`` is positive."""
    if step < 1:
        raise ValueError("frames are read forward: the step is 1 at least")

    def place(v: int) -> F.Column:
        return F.greatest(F.lit(0).cast("long"), F.col("frames") + v) if v < 0 else F.lit(v).cast("long")

    low = place(start or 0)
    high = F.col("frames") if stop is None else place(stop)
    return index.where((F.col("frame") >= low) & (F.col("frame") < high) & ((F.col("frame") - low) % step == 0))


def read_frames(index: DataFrame, kind: str, range_bytes: int = RANGE) -> DataFrame:
    """(file, frame, time, cell, atom, x, y, z) of the frames that rows of a ``frame_index`` name."""
    total = index.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    parse = {"trr": trr_frame, "xtc": xtc_frame}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, header = None, None, None
        for batch in batches:
            for file, frame, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, _open(file)
                    header = dcd_header(lambda at, n, f=f: f.read_at(n, at)) if kind == "dcd" else None
                raw = f.read_at(size, offset)
                time, cell, xyz = dcd_frame(raw, header, frame) if kind == "dcd" else parse[kind](raw)
                n = len(xyz)
                columns = [pa.array([name] * n, pa.string()), pa.array(np.full(n, frame)), pa.array(np.full(n, time)), pa.array([cell] * n, pa.list_(pa.float64())), pa.array(np.arange(n)), *(pa.array(np.ascontiguousarray(xyz[:, k])) for k in range(3))]
                yield pa.RecordBatch.from_arrays(columns, ["file", "frame", "time", "cell", "atom", "x", "y", "z"])
        if f is not None:
            f.close()

    dealt = index.select("file", "frame", "offset", "bytes").repartitionByRange(max(1, -(-total // range_bytes)), "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, SCHEMA)


def read_trajectory(spark: SparkSession, path, kind: str, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Frames ``[start:stop:step]`` of each file; other frames are not read."""
    return read_frames(frame_slice(frame_index(spark, path, kind), start, stop, step), kind)


def read_dcd(spark: SparkSession, path) -> DataFrame:
    """(file, frame, time, cell, atom, x, y, z) of either byte order; the time is in steps times the step's length."""
    return read_trajectory(spark, path, "dcd")


def read_trr(spark: SparkSession, path) -> DataFrame:
    """(file, frame, time, cell, atom, x, y, z), times as stored. Frames of velocities or forces alone are passed over."""
    return read_trajectory(spark, path, "trr")


def read_xtc(spark: SparkSession, path) -> DataFrame:
    """(file, frame, time, cell, atom, x, y, z), times as stored, places to the stored precision."""
    return read_trajectory(spark, path, "xtc")
