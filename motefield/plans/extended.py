"""More registered queries, each held against its SQL: sites and pairs, constraints, regions,
graphs and their edits, third-order invariants, spectra and dielectric curves, potentials and
unit conversions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.functions import geometry, predicates, units
from motefield.functions.box import Box
from motefield.operators import assembly, dynamics, forcefield, generators, graph, neighbors, placement, shape, signal, structure, trajectory, voronoi
from motefield.plans import views as V
from motefield.plans.registry import query, rounded

_r = rounded

_NEAR = f"""{V.PTS}, a AS MATERIALIZED (SELECT frame, atom, atom % 7 AS mol, x, y, z FROM pts WHERE type = 'A'), b AS MATERIALIZED (SELECT frame, atom, atom % 7 AS mol, x, y, z FROM pts WHERE type = 'R'),
d AS (SELECT frame, a.atom AS i, b.atom AS j, a.mol AS mi, b.mol AS mj, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM a JOIN b USING (frame)),
m AS MATERIALIZED (SELECT frame, i, j, sqrt(pow(dx - 50 * round(dx / 50), 2) + pow(dy - 11 * round(dy / 11), 2) + pow(dz - 9 * round(dz / 9), 2)) AS dist FROM d WHERE mi <> mj),
near AS MATERIALIZED (SELECT * FROM m WHERE dist <= 1.2)"""


def _sites(spark, d: str) -> DataFrame:
    p = V.pts(spark, d).withColumn("mol", F.col("atom") % 7)
    return assembly.site_pairs(p.where("type = 'A'"), p.where("type = 'R'"), V.BOX, 1.2)


@query(f"WITH {_NEAR} SELECT frame, i, j, round(dist, 6) AS dist FROM near")
def site_pairs(spark, d):
    return _sites(spark, d).select("frame", "i", "j", _r("dist"))


@query(f"WITH {_NEAR} SELECT frame, i, j, row_number() OVER (PARTITION BY frame ORDER BY round(dist, 6), i, j) AS rank FROM near")
def candidate_order(spark, d):
    pairs = _sites(spark, d).withColumn("dist", F.round("dist", 6))
    return assembly.candidate_rank(pairs).select("frame", "i", "j", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_NEAR} SELECT count(DISTINCT i) AS sites_a, count(DISTINCT j) AS sites_b, CAST(ceil(0.35 * least(count(DISTINCT i), count(DISTINCT j))) AS BIGINT) AS n FROM near")
def limiting_count(spark, d):
    return assembly.limiting_count(_sites(spark, d), 0.35)


@query(f"WITH {V.PTS}, s AS (SELECT *, row_number() OVER (PARTITION BY frame, type ORDER BY atom) - 1 AS k FROM pts) SELECT frame, atom FROM s WHERE k % 4 = 0")
def spacing_sites(spark, d):
    return assembly.every_nth(V.pts(spark, d), 4, by=("frame", "type")).select("frame", "atom")


@query(f"WITH {V.PTS}, s AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY atom) - 1 AS k FROM pts) SELECT frame, atom, CASE WHEN k % 5 = 0 THEN 'R' END AS site FROM s")
def site_labels(spark, d):
    return assembly.label_sites(V.pts(spark, d), 5, "R", by=("frame",)).select("frame", "atom", "site")


@query(f"WITH {V.PTS} SELECT frame, type, count(*) AS n FROM pts GROUP BY 1, 2")
def type_tally(spark, d):
    return assembly.tally(V.pts(spark, d), "type", by=("frame",))


@query("""WITH l AS (SELECT p_brand AS type FROM part UNION SELECT CAST(p_size AS VARCHAR) FROM part)
SELECT type, row_number() OVER (ORDER BY NOT regexp_full_match(type, '[0-9]+'), TRY_CAST(type AS BIGINT), type) AS id FROM l""")
def type_map(spark, d):
    p = V.table(spark, d, "part")
    return assembly.type_map(p.select(F.col("p_brand").alias("type")), p.select(F.col("p_size").alias("type")))


@query("""WITH a AS (SELECT s_suppkey AS atom FROM supplier), m AS (SELECT atom // 3 AS bead, atom FROM a WHERE atom % 5 <> 0 UNION SELECT 1000 + atom % 4, atom FROM a WHERE atom % 7 = 0)
SELECT a.atom, coalesce(string_agg(CAST(bead AS VARCHAR), ',' ORDER BY bead), '') AS beads FROM a LEFT JOIN m ON m.atom = a.atom GROUP BY 1""")
def bead_membership(spark, d):
    a = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("atom"))
    members = a.where("atom % 5 <> 0").select(F.floor(F.col("atom") / 3).alias("bead"), "atom").union(a.where("atom % 7 = 0").select((1000 + F.col("atom") % 4).alias("bead"), "atom"))
    return assembly.beads_of(a, members).select("atom", F.array_join(F.transform("beads", lambda b: b.cast("string")), ",").alias("beads"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS atom, CAST(c.range + 1 AS BIGINT) AS mol, round(n_regionkey * 1.5 + c.range * 4.0, 6) AS x, CAST(n_nationkey AS DOUBLE) AS y FROM nation, range(3) c")
def replicas(spark, d):
    strand = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("atom"), (F.col("n_regionkey") * 1.5).alias("x"), F.col("n_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return assembly.replicas_line(strand, 3, 4.0).select("atom", "mol", _r("x"), "y")


_IN = "(x BETWEEN 5 AND 40 AND y BETWEEN 1 AND 9 AND z BETWEEN 0 AND 7)"
_BALL = "sqrt(pow(x - 25, 2) + pow(y - 5, 2) + pow(z - 4, 2))"


def _constraint():
    return placement.inside_box((35, 8, 7), (5, 1, 0)) & placement.outside_sphere(6.0, (25, 5, 4))


@query(f"WITH {V.PTS}, c AS (SELECT frame, CAST(count(*) FILTER (WHERE NOT {_IN}) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE {_BALL} <= 6) AS DOUBLE) AS b FROM pts GROUP BY 1) SELECT frame, a + b AS both, least(a, b) AS either FROM c")
def constraint_penalty(spark, d):
    p = V.pts(spark, d)
    one, two = placement.inside_box((35, 8, 7), (5, 1, 0)), placement.outside_sphere(6.0, (25, 5, 4))
    both = placement.penalty(p, one & two, by=("frame",)).withColumnRenamed("penalty", "both")
    return both.join(placement.penalty(p, one | two, by=("frame",)).withColumnRenamed("penalty", "either"), "frame")


@query(f"""WITH {V.PTS}, g AS (SELECT frame, atom, CASE WHEN {_IN} THEN 0 WHEN x < 5 THEN 1 WHEN x > 40 THEN -1 ELSE 0 END AS bx, CASE WHEN {_BALL} <= 6 AND {_BALL} > 1e-8 THEN -(x - 25) / {_BALL} ELSE 0 END AS sx,
 CASE WHEN {_IN} THEN 0 WHEN z > 7 THEN -1 ELSE 0 END AS bz, CASE WHEN {_BALL} <= 6 AND {_BALL} > 1e-8 THEN -(z - 4) / {_BALL} ELSE 0 END AS sz FROM pts)
SELECT frame, atom, round(bx + sx, 6) + 0.0 AS gx, round(bz + sz, 6) + 0.0 AS gz FROM g""")
def constraint_gradient(spark, d):
    return placement.gradient(V.pts(spark, d), _constraint(), by=("frame",)).select("frame", "atom", _r("gx"), _r("gz"))


@query(f"WITH {V.pairs_sql(1.5)}, f AS (SELECT DISTINCT frame FROM pts), s AS (SELECT frame, sum(pow(1.5 - dist, 2)) AS p FROM pairs GROUP BY 1) SELECT f.frame, round(coalesce(p, 0), 4) AS penalty FROM f LEFT JOIN s ON s.frame = f.frame")
def min_distance_penalty(spark, d):
    return placement.min_distance_penalty(V.pts(spark, d), 1.5, V.BOX).select("frame", _r("penalty", 4))


@query(f"""WITH {V.pairs_sql(1.5)}, {V.WAYS}, s AS (SELECT frame, i, sum(-2 * (1.5 - dist) * dx / dist) AS gx FROM ways WHERE dist > 1e-8 GROUP BY 1, 2)
SELECT pts.frame, pts.atom, round(coalesce(gx, 0), 4) + 0.0 AS gx FROM pts LEFT JOIN s ON s.frame = pts.frame AND s.i = pts.atom""")
def min_distance_gradient(spark, d):
    return placement.min_distance_gradient(V.written_pts(spark, d), 1.5, V.BOX).select("frame", "atom", _r("gx", 4))


@query(f"""WITH {V.pairs_sql(1.5)}, {V.WAYS}, q AS (SELECT frame, i, avg(1.5 * dx * dx / (dist * dist) - 0.5) AS a, avg(1.5 * dy * dy / (dist * dist) - 0.5) AS b, avg(1.5 * dz * dz / (dist * dist) - 0.5) AS c,
 avg(1.5 * dx * dy / (dist * dist)) AS d, avg(1.5 * dx * dz / (dist * dist)) AS e, avg(1.5 * dy * dz / (dist * dist)) AS f FROM ways WHERE dist > 0 GROUP BY 1, 2),
t AS (SELECT frame, i, a * a + b * b + c * c + 2 * (d * d + e * e + f * f) AS t2, 3 * (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) AS t3 FROM q)
SELECT frame, i AS atom, round({-math.sqrt(12 / 35)!r} * t3 / pow(t2, 1.5), 4) + 0.0 AS w FROM t WHERE t2 > 0.01""")
def steinhardt_third(spark, d):
    """Degree two, whose invariants are those of the mean tensor of bond directions."""
    pairs = neighbors.neighbor_pairs(V.pts(spark, d), V.BOX, 1.5)
    found = structure.steinhardt(pairs, 2, third=True, normalize=True)
    return found.where(F.col("q") * F.col("q") * 1.5 > 0.01).select("frame", "atom", _r("w", 4))


@query(f"WITH {V.PTS} SELECT frame, atom FROM pts WHERE (x BETWEEN 10 AND 20 AND y BETWEEN 2 AND 6 AND z BETWEEN 1 AND 5) OR (pow(x - 40, 2) + pow(y - 5, 2) + pow(z - 4, 2) BETWEEN 4 AND 30.25 AND NOT pow(x - 42, 2) + pow(y - 5, 2) + pow(z - 4, 2) <= 4) OR (x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 AND z BETWEEN 2 AND 5)")
def regions(spark, d):
    s = predicates
    chosen = s.cuboid((10, 2, 1), (20, 6, 5)) | (s.hollow_sphere((40, 5, 4), 2, 5.5) & ~s.sphere((42, 5, 4), 2)) | s.cube((2, 2, 2), 3)
    return V.pts(spark, d).where(chosen).select("frame", "atom")


@query(f"WITH {V.PTS}, k AS (SELECT DISTINCT CAST(n_regionkey AS BIGINT) * 7 AS atom FROM nation) SELECT frame, atom FROM pts WHERE atom IN (3, 5, 8) OR atom IN (SELECT atom FROM k)")
def index_selection(spark, d):
    p = V.pts(spark, d)
    keys = V.table(spark, d, "nation").select((F.col("n_regionkey").cast("long") * 7).alias("atom"))
    return p.where(predicates.by_index([3, 5, 8], "atom")).select("frame", "atom").union(predicates.select_ids(p, keys, "atom").select("frame", "atom")).distinct()


@query(f"WITH {V.GRAPH} SELECT atomi, atomj FROM graph WHERE (atomi % 3 <> 0) AND (atomj % 3 <> 0)")
def induced_edges(spark, d):
    g = V.graph(spark, d)
    atoms = g.select(F.explode(F.array("atomi", "atomj")).alias("atom")).distinct().where("atom % 3 <> 0")
    return predicates.induced_edges(g, atoms).select("atomi", "atomj")


@query(f"WITH {V.GRAPH} SELECT atomi, atomj FROM graph WHERE atomi % 4 <> 1 AND atomj % 4 <> 1")
def remove_atoms(spark, d):
    g = V.graph(spark, d)
    atoms = g.select(F.explode(F.array("atomi", "atomj")).alias("atom")).distinct()
    return graph.remove_atoms(atoms, [g], F.col("atom") % 4 == 1)[1][0].select("atomi", "atomj")


@query(f"WITH {V.GRAPH} SELECT a AS atom, b AS neighbor FROM edges WHERE a BETWEEN 100 AND 110")
def graph_neighbors(spark, d):
    return graph.neighbors_of(V.graph(spark, d), spark.range(100, 111).select(F.col("id").alias("atom")))


@query(f"""WITH RECURSIVE {V.GRAPH}, walk AS (SELECT CAST(101 AS BIGINT) AS atom, 0 AS hops UNION SELECT b, hops + 1 FROM walk JOIN edges ON atom = a WHERE hops < 2), n AS (SELECT atom, min(hops) AS hops FROM walk GROUP BY 1),
o AS (SELECT DISTINCT a FROM edges WHERE b NOT IN (SELECT atom FROM n)) SELECT atom, CAST(hops AS INTEGER) AS hops, atom IN (SELECT a FROM o) AS boundary FROM n""")
def subgraph(spark, d):
    atoms, _, boundary = graph.ball(V.graph(spark, d), spark.createDataFrame([(101,)], "atom long"), 2)
    return atoms.join(boundary.withColumn("boundary", F.lit(True)), "atom", "left").select("atom", "hops", F.coalesce("boundary", F.lit(False)).alias("boundary"))


_TWO = f"WITH {V.GRAPH}, t AS (SELECT max(greatest(atomi, atomj)) + 1 AS s FROM graph)"


@query(f"{_TWO} SELECT atomi, atomj FROM graph UNION ALL SELECT atomi + s, atomj + s FROM graph, t WHERE atomi >= 1000")
def graph_merge(spark, d):
    g = V.graph(spark, d)
    atoms = g.select(F.explode(F.array("atomi", "atomj")).alias("atom")).distinct()
    return graph.merge(atoms, g, atoms, g.where("atomi >= 1000"))[1].select("atomi", "atomj")


@query(f"{_TWO} SELECT atomi + s * c.range AS atomi, atomj + s * c.range AS atomj, CAST(c.range AS INTEGER) AS copy FROM graph, t, range(3) c")
def graph_replicate(spark, d):
    g = V.graph(spark, d)
    atoms = g.select(F.explode(F.array("atomi", "atomj")).alias("atom")).distinct()
    return graph.replicate(atoms, g, 3)[1].select("atomi", "atomj", "copy")


@query(f"WITH {V.WALKS}, b AS (SELECT unnest([0, 5, 12, 40]) AS frame) SELECT particle, w.frame, CAST(count(b.frame) AS INTEGER) - 1 AS segment FROM walks w LEFT JOIN b ON b.frame <= w.frame GROUP BY 1, 2")
def split_custom(spark, d):
    marks = spark.createDataFrame([(0,), (5,), (12,), (40,)], "frame int")
    return trajectory.split_at(V.walks(spark, d), marks, ["particle"]).select("particle", "frame", "segment")


@query(f"WITH {V.SERIES}, a AS (SELECT frame, m FROM series WHERE frame % 2 = 0), b AS (SELECT frame, p FROM series WHERE frame % 3 = 0) SELECT frame, round(m, 4) AS m, round(p, 4) AS p FROM a JOIN b USING (frame)")
def zip_readers(spark, d):
    s = V.series(spark, d)
    return trajectory.zip_frames(s.where("frame % 2 = 0").select("frame", "m"), s.where("frame % 3 = 0").select("frame", "p")).select("frame", _r("m", 4), _r("p", 4))


@query("SELECT p_type AS class, max(CAST(p_size AS INTEGER)) AS layer FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1")
def class_layers(spark, d):
    types = V.table(spark, d, "part").select(F.when(F.col("p_brand") == "Brand#11", "*").otherwise(F.col("p_brand")).alias("type"), F.col("p_type").alias("class"), F.col("p_size").cast("int").alias("layer"))
    return forcefield.class_layers(types)


@query("""WITH p AS (SELECT p_brand AS type, max(p_retailprice) AS sigma FROM part WHERE p_size % 2 = 0 GROUP BY 1) SELECT s.s_suppkey AS id, 'Brand#' || (1 + s_suppkey % 5) || (1 + s_suppkey % 4) AS type, round(sigma, 4) AS sigma
FROM supplier s LEFT JOIN p ON p.type = 'Brand#' || (1 + s_suppkey % 5) || (1 + s_suppkey % 4)""")
def pair_parameters(spark, d):
    k = F.col("s_suppkey")
    types = V.table(spark, d, "supplier").select(k.alias("id"), F.concat(F.lit("Brand#"), (1 + k % 5).cast("string"), (1 + k % 4).cast("string")).alias("type"))
    pairs = V.table(spark, d, "part").where("p_size % 2 = 0").groupBy(F.col("p_brand").alias("type")).agg(F.max("p_retailprice").alias("sigma")).withColumn("id", F.lit(0))
    return forcefield.merge_pair_parameters(types, pairs).select("id", "type", _r("sigma", 4))


@query(f"""WITH {V.PTS}, s AS (SELECT frame, atom, x, first_value(x) OVER (PARTITION BY frame ORDER BY atom) AS s FROM pts) SELECT frame, atom, round(s + (x - s) - 50 * round_even((x - s) / 50, 0), 6) AS x FROM s""")
def unwrap_cluster(spark, d):
    return shape.unwrap_to_seed(V.pts(spark, d), ["frame"], V.BOX).select("frame", "atom", _r("x"))


@query(f"""WITH {V.PTS}, t AS (SELECT frame, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM pts GROUP BY 1)
SELECT frame, round(1 - 3 * (a * b + b * c + c * a - d * d - e * e - f * f) / pow(a + b + c, 2), 5) AS kappa2 FROM t""")
def shape_anisotropy(spark, d):
    """Held against the second invariant, which needs no eigenvalues."""
    return shape.shape_descriptors(shape.moments(V.pts(spark, d), ["frame"])).select("frame", _r("kappa2", 5))


_SUMS = f"WITH {V.SERIES}, a AS (SELECT CAST(l.range AS INTEGER) AS lag, sum(s.m * t.m) AS acf FROM series s CROSS JOIN range(12) l JOIN series t ON t.frame = s.frame + l.range GROUP BY 1)"


def _sums(spark, d) -> DataFrame:
    return dynamics.acf_sums(V.series(spark, d), "m", 11)


@query(f"{_SUMS} SELECT lag, round(acf, 2) AS acf FROM a")
def acf_sums(spark, d):
    return _sums(spark, d).select("lag", _r("acf", 2))


@query(f"{_SUMS} SELECT lag, round(acf * (0.5 - 0.5 * cos(lag * {2 * math.pi / 11!r})), 2) + 0.0 AS hann, round(acf * (0.42 - 0.5 * cos(lag * {2 * math.pi / 11!r}) + 0.08 * cos(lag * {4 * math.pi / 11!r})), 2) + 0.0 AS blackman FROM a")
def windowed_curve(spark, d):
    curve = _sums(spark, d)
    one = signal.apply_window(curve, "acf", "hann", 12, "lag").withColumnRenamed("acf", "hann")
    return one.join(signal.apply_window(curve, "acf", "blackman", 12, "lag").withColumnRenamed("acf", "blackman"), "lag").select("lag", _r("hann", 2), _r("blackman", 2))


def _cosines(value: str, n: int, what: str = "cos") -> str:
    return f"sum({value} * {what}(k.range * lag * {2 * math.pi / n!r}))"


_GRID = f"CAST(k.range AS INTEGER) AS k, round(k.range * CAST({2 * math.pi / 6!r} AS DOUBLE), 6) AS omega"


@query(f"{_SUMS} SELECT {_GRID}, round({_cosines('acf * CASE WHEN lag = 0 THEN 0.5 ELSE 1 END', 12)} * 1.0, 2) + 0.0 AS intensity FROM a, range(7) k GROUP BY k.range")
def power_spectrum(spark, d):
    return signal.power_spectrum(_sums(spark, d), "acf", 12, 0.5).select("k", _r("omega"), _r("intensity", 2))


@query(f"""{_SUMS}, s AS (SELECT {_GRID}, {_cosines('acf * CASE WHEN lag = 0 THEN 0.5 ELSE 1 END', 12)} AS i FROM a, range(7) k GROUP BY k.range)
SELECT k, round(i * 49 / 45, 2) + 0.0 AS parallel, round(i / 15, 2) + 0.0 AS perpendicular, round(i * 96 / 90, 2) + 0.0 AS backscattered, round(i * 220 / 90, 2) + 0.0 AS averaged FROM s""")
def raman_and_roa(spark, d):
    curve = _sums(spark, d)
    one = signal.raman_spectrum(curve, curve, 12, 0.5).select("k", "parallel", "perpendicular")
    two = signal.roa_spectrum(curve, curve, 12, 0.5).select("k", F.col("intensity").alias("backscattered"))
    three = signal.roa_spectrum(curve, curve, 12, 0.5, averaged=True).select("k", F.col("intensity").alias("averaged"))
    return one.join(two, "k").join(three, "k").select("k", _r("parallel", 2), _r("perpendicular", 2), _r("backscattered", 2), _r("averaged", 2))


@query(f"""{_SUMS}, p AS (SELECT lag, acf / first_value(acf) OVER (ORDER BY lag) AS y FROM a), g AS (SELECT lag, -CASE WHEN lag = 0 THEN lead(y) OVER w - y WHEN lag = 11 THEN y - lag(y) OVER w ELSE (lead(y) OVER w - lag(y) OVER w) / 2 END * CASE WHEN lag IN (0, 11) THEN 0.5 ELSE 1 END AS v FROM p WINDOW w AS (ORDER BY lag))
SELECT {_GRID}, round(1.5 + 20 * {_cosines('v', 12)}, 5) + 0.0 AS eps_real, round(20 * {_cosines('v', 12, 'sin')}, 5) + 0.0 AS eps_imag FROM g, range(7) k GROUP BY k.range""")
def einstein_helfand(spark, d):
    return signal.einstein_helfand_spectrum(_sums(spark, d), 12, 0.5, 20.0, 1.5).select("k", _r("omega"), _r("eps_real", 5), _r("eps_imag", 5))


@query(f"""{_SUMS} SELECT {_GRID}, round(1 - 1e-6 * {_cosines('acf * 0.5 * CASE WHEN lag IN (0, 11) THEN 0.5 ELSE 1 END', 12, 'sin')} / (k.range * {2 * math.pi / 6!r}), 5) + 0.0 AS eps_real,
 round(1e-6 * {_cosines('acf * 0.5 * CASE WHEN lag IN (0, 11) THEN 0.5 ELSE 1 END', 12)} / (k.range * {2 * math.pi / 6!r}), 5) + 0.0 AS eps_imag FROM a, range(1, 7) k GROUP BY k.range""")
def green_kubo_spectrum(spark, d):
    return signal.green_kubo_spectrum(_sums(spark, d), 12, 0.5, 1e-6).select("k", _r("omega"), _r("eps_real", 5), _r("eps_imag", 5))


@query(f"""WITH {V.SERIES}, c AS (SELECT frame, m - avg(m) OVER () AS m, p - avg(p) OVER () AS p FROM series), a AS (SELECT CAST(l.range AS INTEGER) AS lag, avg(s.m * t.m + s.p * t.p) AS acf, count(*) AS n FROM c s CROSS JOIN range(9) l JOIN c t ON t.frame = s.frame + l.range GROUP BY 1)
SELECT lag, round(acf, 3) AS acf, n, round(acf / first_value(acf) OVER (ORDER BY lag), 6) AS phi FROM a""")
def debye_relaxation(spark, d):
    return dynamics.debye_relaxation(V.series(spark, d), ["m", "p"], 8).select("lag", _r("acf", 3), "n", _r("phi"))


@query(f"""WITH {V.SERIES}, n AS (SELECT s.frame, s.m, a.m AS a, b.m AS b FROM series s LEFT JOIN series a ON a.frame = s.frame + 1 LEFT JOIN series b ON b.frame = s.frame - 1)
SELECT frame, round((coalesce(a, m) - coalesce(b, m)) / (CASE WHEN a IS NULL OR b IS NULL THEN 1 ELSE 2 END * 0.5 * 8.0), 6) + 0.0 AS m FROM n""")
def current_density(spark, d):
    return dynamics.current_density(V.series(spark, d), ["m"], 0.5, 8.0).select("frame", _r("m"))


@query(f"WITH {V.PTS} SELECT frame, sum(CASE WHEN type = 'N' THEN mass * x ELSE 0 END) AS x_in, sum(CASE WHEN type <> 'N' THEN mass * x ELSE 0 END) AS x_out FROM pts GROUP BY 1")
def split_dipole(spark, d):
    return dynamics.split_dipole(V.pts(spark, d), F.col("type") == "N", "mass", ("x",)).select("frame", "x_in", "x_out")


@query(f"{_SUMS}, r AS (SELECT acf, row_number() OVER (ORDER BY lag) - 1 AS k FROM a) SELECT round(avg(acf), 2) AS value, round(stddev_pop(acf), 2) AS spread, count(*) AS n FROM r WHERE k >= 6")
def plateau(spark, d):
    return signal.plateau(_sums(spark, d), "acf", 0.5).select(_r("value", 2), _r("spread", 2), "n")


@query(f"WITH {V.WALKS}, v AS (SELECT CAST(l.range AS INTEGER) AS lag, avg(a.v * b.v) AS y FROM walks a CROSS JOIN range(11) l JOIN walks b ON a.particle = b.particle AND b.frame = a.frame + l.range GROUP BY 1) SELECT round(exp(regr_intercept(ln(y), lag * 0.5)), 1) AS amplitude, count(*) AS n_samples FROM v WHERE y > 0")
def debye_fit(spark, d):
    return dynamics.debye_fit(dynamics.acf(V.walks(spark, d), ["v"], 10), "acf", 0.5).select(_r("amplitude", 1), "n_samples")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_tax AS t, l_discount AS d, l_extendedprice / 40000 AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(0.5 * 2.0 * pow(q - 20, 2), 4) AS harmonic, round(3.0 * pow(1 - exp(-0.1 * (q - 20)), 2), 4) AS morse, round(30 * exp(-q / 9.0) - 4 / pow(q, 6), 6) AS buckingham,
 round(332.06371 * 0.25 * -0.5 / q, 5) AS coulomb FROM r""")
def potentials(spark, d):
    q, lit = F.col("l_quantity"), F.lit
    rows = V.table(spark, d, "lineitem")
    held = rows.withColumns({
        "harmonic": forcefield.harmonic(q, lit(2.0), lit(20.0)), "morse": forcefield.morse(q, lit(3.0), lit(0.1), lit(20.0)),
        "buckingham": forcefield.buckingham(q, lit(30.0), lit(9.0), lit(4.0)), "coulomb": forcefield.coulomb(q, lit(0.25), lit(-0.5)),
    })
    return held.select("l_orderkey", "l_linenumber", "l_partkey", _r("harmonic", 4), _r("morse", 4), _r("buckingham"), _r("coulomb", 5))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS i, 0.1 * l_quantity AS r FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(1 - (1 + 2.6 / pow(1.5 * 0.7, 1 / 6.0) * r / 2) * exp(-2.6 / pow(1.5 * 0.7, 1 / 6.0) * r), 6) + 0.0 AS thole,
 round(1 - exp(-4.5 * r) * (1 + 4.5 * r + pow(4.5 * r, 2) / 2 + pow(4.5 * r, 3) / 6 + pow(4.5 * r, 4) / 24), 6) + 0.0 AS tang_toennies, round((-2 * i - 1.5 * (i % 3)) / 4.184, 6) + 0.0 AS f1, round(-0.25 * (i % 5) / 4.184, 6) + 0.0 AS f4 FROM p""")
def damping_and_torsions(spark, d):
    """At a tenth of every line's quantity."""
    i = F.col("l_quantity").cast("double")
    r = i * 0.1
    f = geometry.rb_to_opls(F.lit(0.0), i, F.lit(0.0), i % 3, i % 5, F.lit(0.0))
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    found = V.table(spark, d, "lineitem").select(*keys, geometry.thole(r, F.lit(2.6), F.lit(1.5), F.lit(0.7)).alias("thole"), geometry.tang_toennies(r, 4.5).alias("tang_toennies"), f[0].alias("f1"), f[3].alias("f4"))
    return found.select(*keys, _r("thole"), _r("tang_toennies"), _r("f1"), _r("f4"))


@query("SELECT s_suppkey, round(s_acctbal * 4.184, 4) AS kilojoules, round(s_acctbal * 0.1, 4) AS nanometres FROM supplier")
def unit_conversion(spark, d):
    s = V.table(spark, d, "supplier")
    b = F.col("s_acctbal")
    energy = units.factor("energy", "real", "si") / units.factor("energy", "real", "si") * 4.184
    return s.select("s_suppkey", F.round(b * energy, 4).alias("kilojoules"), F.round(b * units.factor("length", "real", "si") * 1e9, 4).alias("nanometres"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT n, count(*) AS chains, round(n * pow(1 - 0.9, 2) * pow(0.9, n - 1), 8) AS flory, round(exp(n * ln(4.0) - 4.0) / CAST(factorial(CAST(n AS INTEGER)) AS DOUBLE) / (1 - exp(-4.0)), 8) AS poisson, ['A', 'B', 'C'][1 + (n - 1) % 3] AS unit FROM c GROUP BY n""")
def chain_distributions(spark, d):
    """Orders as chains of their lines, beside what two distributions give for each length."""
    n = F.col("n")
    rows = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("chains"))
    return rows.select("n", "chains", F.round(generators.flory_schulz_pmf(n, 0.9), 8).alias("flory"), F.round(generators.truncated_poisson_pmf(n, 4.0), 8).alias("poisson"), F.element_at(generators.alternating_sequence(["A", "B", "C"], n.cast("int")), -1).alias("unit"))


_TENSOR = f"""{V.pairs_sql(1.5)}, {V.WAYS}, q AS MATERIALIZED (SELECT frame, i, avg(1.5 * dx * dx / (dist * dist) - 0.5) AS a, avg(1.5 * dy * dy / (dist * dist) - 0.5) AS b, avg(1.5 * dz * dz / (dist * dist) - 0.5) AS c,
 avg(1.5 * dx * dy / (dist * dist)) AS d, avg(1.5 * dx * dz / (dist * dist)) AS e, avg(1.5 * dy * dz / (dist * dist)) AS f FROM ways WHERE dist > 0 GROUP BY 1, 2)"""


@query(f"""WITH {_TENSOR}, m AS (SELECT * FROM q UNION ALL SELECT w.frame, w.i, q.a, q.b, q.c, q.d, q.e, q.f FROM ways w JOIN q ON q.frame = w.frame AND q.i = w.j WHERE w.dist > 0),
t AS (SELECT frame, i, avg(a) AS a, avg(b) AS b, avg(c) AS c, avg(d) AS d, avg(e) AS e, avg(f) AS f FROM m GROUP BY 1, 2)
SELECT frame, i AS atom, round(sqrt((a * a + b * b + c * c + 2 * (d * d + e * e + f * f)) / 1.5), 5) AS q FROM t""")
def steinhardt_average(spark, d):
    """Degree two: harmonics averaged over neighbours are the mean of neighbours' tensors."""
    pairs = neighbors.neighbor_pairs(V.pts(spark, d), V.BOX, 1.5)
    return structure.steinhardt(pairs, 2, average=True).select("frame", "atom", _r("q", 5))


@query(f"""WITH {V.pairs_sql(2.1)}, {V.WAYS}, r AS (SELECT cos(i * 0.37) * dx + sin(i * 0.37) * dy AS x, cos(i * 0.37) * dy - sin(i * 0.37) * dx AS y FROM ways WHERE dist > 0),
b AS (SELECT CAST(floor((x + 1.9) / 0.76) AS INTEGER) AS bx, CAST(floor((y + 1.9) / 0.76) AS INTEGER) AS by_ FROM r WHERE abs(x) < 1.9 AND abs(y) < 1.9)
SELECT CAST(p.range AS INTEGER) AS bx, CAST(q.range AS INTEGER) AS "by", count(b.bx) AS count FROM range(5) p CROSS JOIN range(5) q LEFT JOIN b ON b.bx = p.range AND b.by_ = q.range GROUP BY 1, 2""")
def pmft_turned(spark, d):
    p = V.written_pts(spark, d)
    turned = p.select("frame", "atom", (F.col("atom") * 0.37).alias("angle"))
    return structure.pmft_xy(neighbors.neighbor_pairs(p, V.BOX, 2.1), 1.9, 1.9, 5, 5, turned).select("bx", "by", "count")


@query(f"""WITH {V.PTS}, m AS (SELECT t.frame, t.x - r.x AS dx, t.y - r.y AS dy, t.z - r.z AS dz FROM pts t JOIN pts r ON r.frame = t.frame AND r.atom = 0 WHERE t.atom BETWEEN 1 AND 60),
w AS (SELECT dx - 50 * round_even(dx / 50, 0) AS x, dy - 11 * round_even(dy / 11, 0) AS y, dz - 9 * round_even(dz / 9, 0) AS z FROM m),
b AS (SELECT CAST(floor((x + 12.3) / 8.2) AS INTEGER) AS bx, CAST(floor((y + 5.7) / 3.8) AS INTEGER) AS by_, CAST(floor((z + 4.7) / 4.7) AS INTEGER) AS bz FROM w WHERE abs(x) < 12.3 AND abs(y) < 5.7 AND abs(z) < 4.7)
SELECT CAST(p.range AS INTEGER) AS bx, CAST(q.range AS INTEGER) AS "by", CAST(r.range AS INTEGER) AS bz, count(b.bx) AS count, round(count(b.bx) / ((SELECT count(DISTINCT frame) FROM pts) * 8.2 * 3.8 * 4.7), 8) AS density, round(count(b.bx) / ((SELECT count(DISTINCT frame) FROM pts) * 8.2 * 3.8 * 4.7) / 0.12, 6) AS g_sdf
FROM range(3) p CROSS JOIN range(3) q CROSS JOIN range(2) r LEFT JOIN b ON b.bx = p.range AND b.by_ = q.range AND b.bz = r.range GROUP BY 1, 2, 3""")
def spatial_distribution(spark, d):
    """One reference atom has no direction: the body frame is the box's, about that atom."""
    found = structure.spatial_distribution(V.written_pts(spark, d), [0], [[0.0, 0.0, 0.0]], list(range(1, 61)), V.BOX, (3, 3, 2), (12.3, 5.7, 4.7), 0.12)
    return found.select("bx", "by", "bz", "count", _r("density", 8), _r("g_sdf"))


@query(f"""WITH {V.WALKS}, k AS (SELECT particle, frame FROM (SELECT particle, frame, d, max(CASE WHEN d < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY particle, island ORDER BY frame) AS formed FROM (SELECT particle, frame, d, sum(cut) OVER (PARTITION BY particle ORDER BY frame) AS island
 FROM (SELECT particle, frame, abs(v) AS d, CASE WHEN abs(v) > 60 OR lag(frame) OVER w IS NULL OR frame - lag(frame) OVER w > 1 THEN 1 ELSE 0 END AS cut FROM walks WINDOW w AS (PARTITION BY particle ORDER BY frame)))) WHERE formed = 1 AND d <= 60),
s AS (SELECT l.range AS lag, count(*) AS n FROM k a CROSS JOIN range(7) l JOIN k b ON a.particle = b.particle AND b.frame = a.frame + l.range GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS lag, round(coalesce(n, 0) / (p.i * (p.f - r.range)), 6) AS c FROM range(7) r CROSS JOIN (SELECT count(DISTINCT particle) AS i, count(DISTINCT frame) AS f FROM walks) p LEFT JOIN s ON s.lag = r.range""")
def pair_survival_intermittent(spark, d):
    dist = V.walks(spark, d).select(F.col("particle").alias("i"), F.lit(0).alias("j"), "frame", F.abs("v").alias("dist"))
    return dynamics.pair_survival(dist, None, None, 20.0, 60.0, 6, continuous=False).select("lag", _r("c"))


@query(f"""WITH {V.PTS}, p AS (SELECT atom AS particle, frame, x, y, z FROM pts), m AS (SELECT l.lag, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM p a CROSS JOIN (SELECT unnest([1, 3]) AS lag) l JOIN p b ON b.frame = a.frame + l.lag AND b.particle <> a.particle),
r AS (SELECT lag, sqrt(pow(dx - 50 * round_even(dx / 50, 0), 2) + pow(dy - 11 * round_even(dy / 11, 0), 2) + pow(dz - 9 * round_even(dz / 9, 0), 2)) AS r FROM m)
SELECT lag, CAST(floor(r / (4.4 / 7)) AS INTEGER) AS bin, count(*) AS count FROM r WHERE r < 4.4 GROUP BY 1, 2""")
def van_hove_distinct(spark, d):
    p = V.written_pts(spark, d).select(F.col("atom").alias("particle"), "frame", "x", "y", "z")
    return dynamics.van_hove_distinct(p, V.BOX, 7, 4.4, [1, 3]).select("lag", "bin", "count")


@query("SELECT c_nationkey AS frame, count(*) AS cells, 1000.0 AS volume FROM customer GROUP BY 1")
def cell_volumes(spark, d):
    """A frame for each nation's customers; whatever the first cutoff leaves open, the cells of a frame fill its box."""
    place = lambda v: (v - F.floor(v)) * 10
    key = F.col("c_custkey")
    atoms = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("frame"), key.alias("atom"), place((F.col("c_acctbal") + 1000) / 11000).alias("x"), place(key * 0.618034).alias("y"), place(key * 0.754878).alias("z"), (0.5 + key % 5 / 10).alias("radius"))
    cells = voronoi.all_cells(atoms, Box.cubic(10.0), 3.0)
    return cells.groupBy("frame").agg(F.count("*").alias("cells"), F.round(F.sum("volume"), 4).alias("volume"))
