"""Line dedup: common lines stay in one document and go from all others.

A line's key is the line stripped of ASCII white space and lower-cased in A-Z; keys of at
least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines
except in the document with the largest id that holds them.

Keys are hashed to 128 bits and their occurrences (hash, document, position) are
range-partitioned by hash and salt and sorted within a partition by hash, then document from the largest,
then position; streaming over a hash's run keeps the first occurrence of each document and
numbers it. The salt, from the document id, cuts the run of a very common line into parts;
a part is summed up in one row, and the sums of the parts decide. What returns to a document
is a keep bitmap as run lengths, never text: ``keep_runs`` holds the lengths of alternating
runs of kept and dropped lines, a kept run (of length 0 if need be) first.

A null or empty text is one empty line. Rows that share a document id are one document when
documents are counted, but each row's lines go by its own text. Rows of null id are not counted
and keep all lines. Tables without rows give none. Other columns are carried where they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: the white space that keys are stripped of.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Parts of a key's run. Many cost nothing: a key has no more parts than occurrences.
SALTS = 4096


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE)), UPPER, LOWER)


def line_occurrences(docs: DataFrame, min_chars: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(h1, h2, doc, t, pos) of each line that is long enough, in a key of 128 bits; ``t`` is a
    hash of the text that it is in."""
    held = docs.where((F.length(text) >= min_chars) & F.col(key).isNotNull())
    hashed = held.select(F.col(key).alias("doc"), F.xxhash64(text).alias("t"), F.split(F.col(text), "\n", -1).alias("all"))
    lines = hashed.select("doc", "t", F.posexplode("all").alias("pos", "line"))
    return (
        lines.where(F.length("line") >= min_chars)
        .select("doc", "t", "pos", line_key(F.col("line")).alias("k"))
        .where(F.length("k") >= min_chars)
        .select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(11), "k").alias("h2"), "doc", "t", "pos")
    )


def common_lines(occurrences: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, last) of keys in at least ``min_docs`` documents; last: their largest id."""
    spark = occurrences.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt")
    run = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("doc"), "pos")
    streamed = (
        occurrences.select("h1", "h2", salt, "doc", "pos")
        .repartitionByRange(parts, "h1", "h2", "salt")
        .sortWithinPartitions("h1", "h2", "salt", F.desc("doc"), "pos")
        .withColumn("before", F.lag("doc").over(run))
        .where(F.col("before").isNull() | (F.col("before") != F.col("doc")))
    )
    return (
        streamed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last"))
        .where(F.col("n") >= min_docs).select("h1", "h2", "last")
    )


def keep_runs(n_lines: Column, dropped: Column) -> Column:
    """Run lengths of the bitmap of kept lines, a kept run first, given the sorted positions of
    dropped ones.

    A run ends where kept and dropped lines meet; those places are the positions p whose
    neighbour p - 1 is of the other kind, and their differences are the runs.
    """
    after = F.transform(dropped, lambda p: p + 1)
    ends = F.array_except(F.array_except(after, dropped), F.array(n_lines))
    edges = F.concat(F.array(F.lit(0)), F.sort_array(F.concat(F.array_except(dropped, after), ends)), F.array(n_lines))
    # bound to a variable: what stands inside a lambda, such as ``n_lines``, is evaluated for each element
    return F.element_at(F.transform(F.array(edges), lambda e: F.zip_with(F.slice(e, 2, F.size(e) - 1), F.slice(e, 1, F.size(e) - 1), lambda b, a: b - a)), 1)


def kept_text(lines: Column, dropped: Column) -> Column:
    """The lines whose positions are not dropped, joined, in work linear in their number."""

    def joined(held: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(held) - 1), dropped)
        return F.array_join(F.transform(kept, lambda p: F.get(held, p)), "\n")

    return F.element_at(F.transform(F.array(lines), joined), 1)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``n_lines``, ``n_dropped``, ``keep_runs`` and the ``kept`` text of each row, and
    the columns named in ``carry``."""
    occurrences = materialize(line_occurrences(docs, min_chars, key, text), "lines")
    # written, so that the join can split the rows of a very common line
    common = materialize(common_lines(occurrences, min_docs), "common")
    dropped = (
        occurrences.join(common, ["h1", "h2"]).where(F.col("doc") != F.col("last"))
        .groupBy(F.col("doc").alias("_doc"), F.col("t").alias("_t")).agg(F.array_sort(F.collect_set("pos")).alias("_dropped"))
    )
    given = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(text).alias("_hash"), *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)])
    # written too, so that the join can split the copies of a row that is repeated very often
    rows = given.join(materialize(dropped, "dropped"), (F.col("_key") == F.col("_doc")) & (F.col("_hash") == F.col("_t")), "left")
    lines = F.split(F.col("_text"), "\n", -1)
    n_lines = F.size(lines)
    none = F.col("_dropped").isNull()
    return rows.select(
        F.col("_key").alias(key),
        n_lines.cast("long").alias("n_lines"),
        F.when(none, F.lit(0)).otherwise(F.size("_dropped")).cast("long").alias("n_dropped"),
        F.when(none, F.array(n_lines)).otherwise(keep_runs(n_lines, F.col("_dropped"))).alias("keep_runs"),
        F.when(none, F.col("_text")).otherwise(kept_text(lines, F.col("_dropped"))).alias("kept"),
        *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)],
    )
