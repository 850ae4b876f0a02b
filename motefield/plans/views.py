"""Particle views of the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motefield.functions.box import Box
from motefield.storage import materialize

#: Lattice points: x in 1..50, y in 0..10, z in 0..8.
BOX = Box.orthogonal(50.0, 11.0, 9.0)

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, atom, x, y, z, mass, type): a frame for each supplier, an atom for each line."""
    number = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*_ORDER)) - 1
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("frame"), number.cast("long").alias("atom"), F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), F.round(F.col("l_tax") * 100).alias("z"),
        F.col("l_quantity").alias("mass"), F.col("l_returnflag").alias("type"),
    )


def written_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pts`` written, for what reads them more than once: lines are numbered once."""
    return materialize(pts(spark, sf_dir), "pts")


PTS = f"""pts AS MATERIALIZED (SELECT l_suppkey AS frame, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(_ORDER)}) - 1 AS atom,
  l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z, l_quantity AS mass, l_returnflag AS type FROM lineitem)"""


def pairs_sql(cutoff: float) -> str:
    """Every pair of a frame compared, the brute force that the cell join is held against."""
    return f"""{PTS}, diff AS (SELECT a.frame, a.atom AS i, b.atom AS j, a.type AS type_i, b.type AS type_j,
  b.x - a.x - 50 * round((b.x - a.x) / 50) AS dx, b.y - a.y - 11 * round((b.y - a.y) / 11) AS dy, b.z - a.z - 9 * round((b.z - a.z) / 9) AS dz
  FROM pts a JOIN pts b ON a.frame = b.frame AND a.atom < b.atom),
pairs AS MATERIALIZED (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS dist FROM diff WHERE dx * dx + dy * dy + dz * dz <= {cutoff * cutoff})"""


#: Zero has no sign here: an angle of a zero step is 0, not pi.
WAYS = """ways AS MATERIALIZED (SELECT frame, i, j, dx, dy, dz, dist FROM pairs UNION ALL SELECT frame, j, i, 0 - dx, 0 - dy, 0 - dz, dist FROM pairs)"""


def _since_epoch(unit: str) -> Column:
    """Whole units of ``ts`` since 1970 as its clock shows it, whichever zone the session has."""
    return F.timestamp_diff(unit, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(particle, frame, time, x, v): each user's events in order, x the running sum of v."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.col("value") - 50
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("particle"), (F.row_number().over(w) - 1).cast("int").alias("frame"), _since_epoch("MICROSECOND").cast("double").alias("time"),
        # values have two decimals: rounded, the sum does not hang on the order of its additions
        F.round(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("x"), v.alias("v"),
    )


WALKS = """walks AS MATERIALIZED (SELECT user_id AS particle, CAST(row_number() OVER w - 1 AS INTEGER) AS frame, CAST(epoch_us(ts) AS DOUBLE) AS time,
  round(sum(value - 50) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS x, value - 50 AS v
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, m, p): hourly sums of value less 50, of purchases and of all else."""
    hour = F.floor(_since_epoch("MICROSECOND") / 3_600_000_000)
    buys = F.col("event_type") == "purchase"
    sums = table(spark, sf_dir, "events").groupBy(hour.alias("frame")).agg(F.sum(F.when(buys, F.col("value") - 50).otherwise(0.0)).alias("m"), F.sum(F.when(~buys, F.col("value") - 50).otherwise(0.0)).alias("p"))
    return sums


SERIES = """series AS MATERIALIZED (SELECT CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS frame, sum(CASE WHEN event_type = 'purchase' THEN value - 50 ELSE 0 END) AS m,
  sum(CASE WHEN event_type <> 'purchase' THEN value - 50 ELSE 0 END) AS p FROM events GROUP BY 1)"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(atomi, atomj): suppliers to nations to regions, in disjoint ranges of ids."""
    a = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("atomi"), F.col("n_regionkey").cast("long").alias("atomj"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).cast("long").alias("atomi"), (F.col("s_nationkey") + 100).cast("long").alias("atomj"))
    return a.union(b)


GRAPH = """graph AS MATERIALIZED (SELECT CAST(n_nationkey + 100 AS BIGINT) AS atomi, CAST(n_regionkey AS BIGINT) AS atomj FROM nation
  UNION ALL SELECT CAST(s_suppkey + 1000 AS BIGINT), CAST(s_nationkey + 100 AS BIGINT) FROM supplier),
edges AS MATERIALIZED (SELECT atomi AS a, atomj AS b FROM graph UNION ALL SELECT atomj, atomi FROM graph)"""


def molecules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Atoms (atom, mol, label, mass, charge) and bonds (atomi < atomj, kind, strength), written: an atom for each line.

    An order's lines are a ring, with a chord from the first to the middle of six and more; orders are linked
    in molecules of eight.
    """
    w = Window.partitionBy("l_orderkey")
    number = F.row_number().over(w.orderBy(*_ORDER[1:])) - 1
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ord"), number.cast("long").alias("k"), F.count("*").over(w).alias("n"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("mass"), F.round(F.col("l_tax") * 100).cast("long").alias("charge"))
    lines = materialize(lines, "lines")
    atom = F.col("ord") * 1000 + F.col("k")
    atoms = lines.select(atom.alias("atom"), F.floor(F.col("ord") / 8).alias("mol"), "label", "mass", "charge")
    first = lines.where("k = 0").select("ord", "n", (F.col("ord") * 1000).alias("atomi"))
    parts = [
        lines.where("k < n - 1").select(atom.alias("atomi"), (atom + 1).alias("atomj"), F.lit("chain").alias("kind")),
        first.where("n > 2").select("atomi", (F.col("atomi") + F.col("n") - 1).alias("atomj"), F.lit("ring").alias("kind")),
        first.where("n > 5").select("atomi", (F.col("atomi") + F.floor(F.col("n") / 2)).alias("atomj"), F.lit("chord").alias("kind")),
        first.where("ord % 8 <> 7").select((F.col("ord") + 1).alias("ord"), "atomi").join(first.select("ord", (F.col("atomi") + F.col("n") - 1).alias("atomj")), "ord").select("atomi", "atomj", F.lit("link").alias("kind")),
    ]
    bonds = reduce(DataFrame.union, parts)
    return atoms, materialize(bonds.withColumn("strength", (1 + (F.col("atomi") + F.col("atomj")) % 2).cast("int")), "bonds")


MOLECULES = f"""lines AS MATERIALIZED (SELECT l_orderkey AS ord, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER[1:])}) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n,
  l_returnflag AS label, l_quantity AS mass, CAST(round(l_tax * 100) AS BIGINT) AS charge FROM lineitem),
atoms AS MATERIALIZED (SELECT ord * 1000 + k AS atom, ord // 8 AS mol, label, mass, charge FROM lines),
bonds AS MATERIALIZED (SELECT *, CAST(1 + (atomi + atomj) % 2 AS INTEGER) AS strength FROM (SELECT ord * 1000 + k AS atomi, ord * 1000 + k + 1 AS atomj, 'chain' AS kind FROM lines WHERE k < n - 1
  UNION ALL SELECT ord * 1000, ord * 1000 + n - 1, 'ring' FROM lines WHERE k = 0 AND n > 2 UNION ALL SELECT ord * 1000, ord * 1000 + n // 2, 'chord' FROM lines WHERE k = 0 AND n > 5
  UNION ALL SELECT a.ord * 1000, b.ord * 1000 + b.n - 1, 'link' FROM lines a JOIN lines b ON a.k = 0 AND b.k = 0 AND b.ord = a.ord + 1 AND a.ord % 8 <> 7)),
ways AS MATERIALIZED (SELECT atomi AS a, atomj AS b, kind, strength FROM bonds UNION ALL SELECT atomj, atomi, kind, strength FROM bonds)"""
