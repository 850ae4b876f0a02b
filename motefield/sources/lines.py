"""Lines of text files in their order, and files of lines written in order.

A large text file is read by many tasks. A line's place is the byte where its split begins and
its number in the task: split by split a file's lines are read in order, so the two sort the
lines of a file without counting them. Sections are told by their heading lines, of which a
file has few; those are gathered per file and joined back on the file's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.storage import materialize


def numbered_lines(spark: SparkSession, path, separator: str | None = None) -> DataFrame:
    """(file, at, value): ``at`` sorts the lines of a file, or what stands between separators.
    Carriage returns are dropped."""
    raw = (spark.read.text(path) if separator is None else spark.read.text(path, lineSep=separator)).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")).alias("at"),
        F.regexp_replace("value", "\r$", "").alias("value"),
    )
    # written once: a line's number must not change between the two uses below
    return materialize(raw, "text")


def ranked_lines(spark: SparkSession, path) -> DataFrame:
    """(file, line, value) with a file's lines numbered from 0: lines are counted by split, and
    the sums over the splits before - as many rows as splits - added."""
    told = numbered_lines(spark, path).withColumn("split", F.col("at.split"))
    sizes = told.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at.line").alias("first"))
    splits = sizes.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("split", "n", "first"))).alias("s"))
    joined = told.join(splits, "file")
    before = F.aggregate(F.filter("s", lambda x: x["split"] < F.col("split")), F.lit(0).cast("long"), lambda t, x: t + x["n"])
    own = F.element_at(F.filter("s", lambda x: x["split"] == F.col("split")), 1)
    return joined.select("file", (before + F.col("at.line") - own["first"]).alias("line"), "value")


def in_sections(lines: DataFrame, heading: Column) -> DataFrame:
    """Lines with ``section``, the last heading at or before them (null before the first), and
    ``opens``, that heading's place. ``heading`` is a Column: the section's name on the lines
    that open one, else null."""
    heads = lines.withColumn("name", heading).where("name is not null").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("_heads"))
    joined = lines.join(heads, "file", "left")
    last = F.element_at(F.filter("_heads", lambda h: h["at"] <= F.col("at")), -1)
    return joined.withColumn("_h", F.when(F.size(F.filter("_heads", lambda h: h["at"] <= F.col("at"))) > 0, last)).select("file", "at", "value", F.col("_h.name").alias("section"), F.col("_h.at").alias("opens"))


def fields(value: Column, comment: str | None = "#") -> Column:
    """The words of a line, without a comment."""
    plain = F.regexp_replace(value, f"{comment}.*", "") if comment else value
    return F.filter(F.split(F.trim(plain), r"\s+"), lambda w: w != "")


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """The column ``value`` of ``lines`` sorted by ``order``, in files that follow one another by
    name: a range partitioning, so that no group of lines is one row or one task."""
    lines.orderBy(*order).select("value").write.text(path)
