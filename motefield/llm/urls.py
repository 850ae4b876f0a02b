"""URL filters: host-suffix and path-prefix expressions joined with rules by hash.

Each url is expanded into every suffix of its host at a label boundary and every prefix of
its path, as far as rules of that many labels and that path length exist. An expression's
SHA-256 gives a short prefix (an integer) that both sides are equi-joined on; then the full
digests are compared, and the longest rule that fits wins.

Rules are loaded as a table (``host``, ``path``, ``verdict``). Their sizes - the numbers of
labels and the path lengths that occur - are gathered by an aggregate of as many rows as
there are different lengths. The rules are joined by a shuffle unless Spark knows them to be
under its own broadcast limit.

Null urls, urls without ``://`` and empty urls have an empty host and path, which no rule
fits. Hosts lower-case A-Z alone. Of rules that are equal, block wins over allow. Rules whose
host, path or verdict is null are ignored. Repeated urls each get their row. A url that no
rule fits is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expression_digest(host: Column, path: Column) -> Column:
    """SHA-256 of an expression, led by the host's length so that the two parts can't be mistaken."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit("\n"), host, path).cast("binary"), 256)


def short_prefix(digest: Column) -> Column:
    """The first four bytes of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` (host and path of the rule, else null) and
    ``verdict`` (allow or block) of each row of ``pages``.
    """
    known = (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max("verdict").alias("r_verdict"))
        .withColumn("r_digest", expression_digest(F.col("r_host"), F.col("r_path")))
        .withColumn("short", short_prefix(F.col("r_digest")))
    )
    # no more entries than the longest host has labels and the longest path has letters
    sizes = known.agg(F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")).first()
    labels, lengths = (F.lit(sorted(x)).cast("array<int>") if x else F.array().cast("array<int>") for x in sizes)
    split = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # equal (host, path) need one look-up, however many pages share them
    targets = split.select("host", "path").where("host <> ''").distinct()
    expanded = (
        targets.withColumn("_labels", F.split("host", r"\."))
        .withColumn("n", F.explode(labels))
        .where(F.col("n") <= F.size("_labels"))
        .withColumn("suffix", F.array_join(F.slice("_labels", F.size("_labels") - F.col("n") + 1, F.col("n")), "."))
        .withColumn("m", F.explode(lengths))
        .where(F.col("m") <= F.length("path"))
        .withColumn("digest", expression_digest(F.col("suffix"), F.expr("substring(path, 1, m)")))
        .withColumn("short", short_prefix(F.col("digest")))
        .select("host", "path", "short", "digest")
    )
    longest = (
        expanded.join(known, "short")
        .where(F.col("digest") == F.col("r_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), "r_host", "r_path", "r_verdict")).alias("best"))
    )
    # no rule fits an empty host, so these rows need no join; written, so that the join can split the rows of an url that very many pages share
    judged = split.where("host <> ''").join(materialize(longest, "urls"), ["host", "path"], "left").select("_key", "host", "path", "best")
    apart = split.where("host = ''").select("_key", "host", "path", F.lit(None).cast(judged.schema["best"].dataType).alias("best"))
    return judged.union(apart).select(
        F.col("_key").alias(key), "host", "path",
        F.concat("best.r_host", "best.r_path").alias("rule"),
        F.coalesce("best.r_verdict", F.lit("allow")).alias("verdict"),
    )
