"""The registered queries of the particle operators and the SQL they are held against."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.functions import geometry, predicates
from motefield.functions.box import Box
from motefield.operators import components, dynamics, forcefield, generators, graph, neighbors, shape, structure, trajectory
from motefield.operators.histogram import histogram, histogram_nd
from motefield.plans import correlations, extended, reactions, sites  # noqa: F401  they register their queries
from motefield.plans import views as V
from motefield.plans.registry import ORACLE_SQL as ORACLE_SQL
from motefield.plans.registry import QUERIES as QUERIES
from motefield.plans.registry import query, rounded
from motefield.storage import materialize

FLAGSHIP = "rdf"
_r = rounded


def _pairs(spark: SparkSession, d: str, cutoff: float, carry=()) -> DataFrame:
    return neighbors.neighbor_pairs(V.pts(spark, d), V.BOX, cutoff, carry=carry)


@query(f"WITH {V.pairs_sql(1.2)} SELECT frame, i, j, round(dist, 6) AS dist FROM pairs")
def neighbor_list(spark, d):
    return _pairs(spark, d, 1.2).select("frame", "i", "j", _r("dist"))


@query(f"""WITH {V.PTS}, a AS MATERIALIZED (SELECT frame, atom, x, y, z FROM pts WHERE type = 'A'), b AS MATERIALIZED (SELECT frame, atom, x, y, z FROM pts WHERE type = 'R'),
c AS (SELECT frame, a.atom AS i, b.atom AS j, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM a JOIN b USING (frame)),
m AS MATERIALIZED (SELECT frame, i, j, dx - 50 * round(dx / 50) AS dx, dy - 11 * round(dy / 11) AS dy, dz - 9 * round(dz / 9) AS dz FROM c)
SELECT frame, i, j FROM m WHERE dx * dx + dy * dy + dz * dz <= 2.25""")
def cross_neighbors(spark, d):
    p = V.pts(spark, d)
    return neighbors.cross_pairs(p.where("type = 'A'"), p.where("type = 'R'"), V.BOX, 1.5).select("frame", "i", "j")


_RDF = f"""bins AS (SELECT range AS bin FROM range(41)), h AS (SELECT CAST(floor(dist / (4.4 / 41)) AS INTEGER) AS bin, count(*) AS n FROM pairs WHERE dist < 4.4 %s GROUP BY 1),
g AS (SELECT CAST(bins.bin AS INTEGER) AS bin, (bins.bin + 0.5) * (4.4 / 41) AS r, coalesce(n, 0) AS n_r,
  coalesce(n, 0) / ({4 / 3 * math.pi / 4950.0 / 2!r} * (pow((bins.bin + 1) * (4.4 / 41), 3) - pow(bins.bin * (4.4 / 41), 3)) * (SELECT sum(n * n) FROM (SELECT count(*) AS n FROM pts GROUP BY frame))) AS rdf
  FROM bins LEFT JOIN h ON bins.bin = h.bin)"""


@query(f"WITH {V.pairs_sql(4.4)}, {_RDF % ''} SELECT bin, round(r, 6) AS r, n_r, round(rdf, 6) AS rdf FROM g")
def rdf(spark, d):
    p = V.pts(spark, d)
    return structure.rdf(neighbors.neighbor_pairs(p, V.BOX, 4.4), p, V.BOX, 41, 4.4).select("bin", _r("r"), "n_r", _r("rdf"))


@query(f"WITH {V.pairs_sql(4.4)}, {_RDF % ''} SELECT bin, round(sum(r * r * rdf * {4 * math.pi!r} * rho * (4.4 / 41)) OVER (ORDER BY bin), 6) AS n FROM g CROSS JOIN (SELECT sum(n * n) / sum(n) / 4950.0 AS rho FROM (SELECT count(*) AS n FROM pts GROUP BY frame))")
def coordination_number(spark, d):
    p = V.pts(spark, d)
    return structure.coordination(structure.rdf(neighbors.neighbor_pairs(p, V.BOX, 4.4), p, V.BOX, 41, 4.4), structure.density_around(p, V.BOX)).select("bin", _r("n"))


_PARTIAL = "AND type_i = 'N' AND type_j = 'N'"


@query(f"WITH {V.pairs_sql(4.4)}, {_RDF % _PARTIAL} SELECT bin, n_r FROM g")
def partial_rdf(spark, d):
    p = V.pts(spark, d)
    like = neighbors.neighbor_pairs(p.where("type = 'N'"), V.BOX, 4.4)
    return structure.rdf(like, p, V.BOX, 41, 4.4).select("bin", "n_r")


@query(f"""WITH {V.pairs_sql(2.3)}, {V.WAYS}, w AS (SELECT frame, i, sum(least(greatest((2.1 + 0.2 - dist) / 0.4, 0), 1)) AS w FROM ways GROUP BY 1, 2)
SELECT pts.frame, pts.atom, round(coalesce(w, 0), 6) AS num_neighbors, round(coalesce(w, 0) / {4 / 3 * math.pi * 2.1**3!r}, 6) AS density FROM pts LEFT JOIN w ON pts.frame = w.frame AND pts.atom = w.i""")
def local_density(spark, d):
    p = V.pts(spark, d)
    return structure.local_density(neighbors.neighbor_pairs(p, V.BOX, 2.3), p, 2.1, 0.4).select("frame", "atom", _r("num_neighbors"), _r("density"))


@query(f"""WITH {V.PTS}, v AS (SELECT a.range AS ix, b.range AS iy, c.range AS iz FROM range(10) a, range(11) b, range(9) c),
e AS (SELECT frame, ix, iy, iz, (ix + 0.5) * 5 - x AS ax, iy + 0.5 - y AS ay, iz + 0.5 - z AS az FROM pts, v),
m AS (SELECT frame, ix, iy, iz, pow(ax - 50 * round(ax / 50), 2) + pow(ay - 11 * round(ay / 11), 2) + pow(az - 9 * round(az / 9), 2) AS r2 FROM e)
SELECT frame, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, CAST(iz AS INTEGER) AS iz, round(sum(exp(-r2 / 2.42) / {(2 * math.pi * 1.21) ** 1.5!r}), 6) AS density FROM m WHERE r2 <= 10.89 GROUP BY 1, 2, 3, 4""")
def gaussian_density(spark, d):
    return structure.gaussian_density(V.pts(spark, d), V.BOX, (10, 11, 9), 1.1).select("frame", "ix", "iy", "iz", _r("density"))


@query(f"""WITH {V.pairs_sql(1.5)}, {V.WAYS}, b AS (SELECT CAST(floor(acos(dz / dist) / ({math.nextafter(math.pi, 4)!r} / 5)) AS INTEGER) AS theta,
  CAST(floor(fmod(atan2(dy, dx) + {2 * math.pi!r}, {2 * math.pi!r}) / ({2 * math.pi!r} / 7)) AS INTEGER) AS phi FROM ways WHERE dist > 0)
SELECT CAST(t.range AS INTEGER) AS theta, CAST(p.range AS INTEGER) AS phi, count(b.theta) AS count FROM range(5) t CROSS JOIN range(7) p LEFT JOIN b ON b.theta = t.range AND b.phi = p.range GROUP BY 1, 2""")
def bond_order(spark, d):
    return structure.bond_order(_pairs(spark, d, 1.5), 5, 7)


@query(f"""WITH {V.pairs_sql(2.1)}, {V.WAYS}, b AS (SELECT CAST(floor((dx + 1.9) / 0.76) AS INTEGER) AS bx, CAST(floor((dy + 1.9) / 0.76) AS INTEGER) AS by_, FROM ways WHERE dist > 0 AND abs(dx) < 1.9 AND abs(dy) < 1.9),
c AS (SELECT CAST(p.range AS INTEGER) AS bx, CAST(q.range AS INTEGER) AS by_, count(b.bx) AS n FROM range(5) p CROSS JOIN range(5) q LEFT JOIN b ON b.bx = p.range AND b.by_ = q.range GROUP BY 1, 2)
SELECT bx, by_ AS "by", n AS count, round(n / ((SELECT sum(n) FROM c) * 0.76 * 0.76), 6) AS density, CASE WHEN n > 0 THEN round(-ln(n / ((SELECT sum(n) FROM c) * 0.76 * 0.76)), 6) END AS pmf FROM c""")
def pmft(spark, d):
    return structure.pmft_xy(_pairs(spark, d, 2.1), 1.9, 1.9, 5, 5).select("bx", "by", "count", _r("density"), _r("pmf"))


@query(f"""WITH {V.pairs_sql(1.5)}, {V.WAYS} SELECT frame, i AS atom, round(sqrt(pow(avg(cos(4 * atan2(dy, dx))), 2) + pow(avg(sin(4 * atan2(dy, dx))), 2)), 5) + 0.0 AS psi
FROM ways WHERE dx <> 0 OR dy <> 0 GROUP BY 1, 2""")
def hexatic(spark, d):
    return structure.hexatic(_pairs(spark, d, 1.5), 4).select("frame", "atom", _r("psi", 5))


_P6 = "(231 * pow(c, 6) - 315 * pow(c, 4) + 105 * c * c - 5) / 16"
_UNIT = f"{V.WAYS}, u AS MATERIALIZED (SELECT frame, i, j, dx / dist AS x, dy / dist AS y, dz / dist AS z FROM ways WHERE dist > 0)"


@query(f"""WITH {V.pairs_sql(1.5)}, {_UNIT}, c AS (SELECT a.frame, a.i, a.x * b.x + a.y * b.y + a.z * b.z AS c FROM u a JOIN u b ON a.frame = b.frame AND a.i = b.i)
SELECT frame, i AS atom, round(sqrt(greatest(avg({_P6}), 0)), 5) AS q FROM c GROUP BY 1, 2""")
def steinhardt(spark, d):
    """Held against the addition theorem: q^2 is the mean of P_l over pairs of neighbours."""
    return structure.steinhardt(_pairs(spark, d, 1.5), 6).select("frame", "atom", _r("q", 5))


@query(f"""WITH {V.pairs_sql(1.5)}, {_UNIT}, s AS (SELECT frame, i, sqrt(avg({_P6})) AS q FROM (SELECT a.frame, a.i, a.x * b.x + a.y * b.y + a.z * b.z AS c FROM u a JOIN u b ON a.frame = b.frame AND a.i = b.i) GROUP BY 1, 2),
k AS (SELECT frame, i, j, avg({_P6}) AS d FROM (SELECT p.frame, p.i, p.j, a.x * b.x + a.y * b.y + a.z * b.z AS c FROM pairs p JOIN u a ON p.frame = a.frame AND p.i = a.i JOIN u b ON p.frame = b.frame AND p.j = b.i WHERE p.dist > 0) GROUP BY 1, 2, 3),
l AS (SELECT k.frame, k.i, k.j, CASE WHEN k.d / (s.q * t.q) > 0.713 THEN 1 ELSE 0 END AS solid FROM k JOIN s ON s.frame = k.frame AND s.i = k.i JOIN s t ON t.frame = k.frame AND t.i = k.j)
SELECT frame, atom, sum(solid) AS n_solid_bonds, sum(solid) >= 2 AS is_solid FROM (SELECT frame, i AS atom, solid FROM l UNION ALL SELECT frame, j, solid FROM l) GROUP BY 1, 2""")
def solid_liquid(spark, d):
    return structure.solid_liquid(_pairs(spark, d, 1.5), 6, 0.713, 2)


@query(f"""WITH {V.PTS}, {{}}""".format(f"""u AS (SELECT x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM pts)
SELECT round(avg(1.5 * x * x - 0.5), 6) AS qxx, round(avg(1.5 * y * y - 0.5), 6) AS qyy, round(avg(1.5 * z * z - 0.5), 6) AS qzz, round(avg(1.5 * x * y), 6) AS qxy FROM u"""))
def nematic(spark, d):
    q = structure.nematic(V.pts(spark, d).selectExpr("x AS ux", "y AS uy", "z AS uz"))["q_tensor"]
    return spark.createDataFrame([(q[0][0], q[1][1], q[2][2], q[0][1])], "qxx double, qyy double, qzz double, qxy double").select(*[_r(c) for c in ("qxx", "qyy", "qzz", "qxy")])


def _gap(name: str, a: str, b: str) -> str:
    """Minimum image from a to b; a difference of half a box rounds to even, as in the operator."""
    return ", ".join(f"{b}.{c} - {a}.{c} - {l} * round_even(({b}.{c} - {a}.{c}) / {l}, 0) AS {name}{c}" for c, l in zip("xyz", (50, 11, 9), strict=True))


@query(f"""WITH {V.PTS}, d AS MATERIALIZED (SELECT * FROM pts WHERE atom % 3 = 0), a AS MATERIALIZED (SELECT * FROM pts WHERE atom % 3 = 2), h AS MATERIALIZED (SELECT frame, atom - 1 AS donor, x, y, z FROM pts WHERE atom % 3 = 1),
g AS (SELECT d.frame, d.atom AS donor, a.atom AS acceptor, d.x AS ux, d.y AS uy, d.z AS uz, a.x AS vx, a.y AS vy, a.z AS vz, {_gap('a', 'd', 'a')} FROM d JOIN a ON a.frame = d.frame),
n AS MATERIALIZED (SELECT * FROM g WHERE ax * ax + ay * ay + az * az < 9.62),
t AS (SELECT n.frame, n.donor, h.donor + 1 AS hydrogen, n.acceptor, ax, ay, az, {', '.join(f"u{c} - h.{c} - {l} * round_even((u{c} - h.{c}) / {l}, 0) AS p{c}, v{c} - h.{c} - {l} * round_even((v{c} - h.{c}) / {l}, 0) AS q{c}" for c, l in zip('xyz', (50, 11, 9)))}
 FROM n JOIN h ON h.frame = n.frame AND h.donor = n.donor),
c AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS dist, sqrt((px * px + py * py + pz * pz) * (qx * qx + qy * qy + qz * qz)) AS s, px * qx + py * qy + pz * qz AS k FROM t)
SELECT frame, donor, hydrogen, acceptor, round(dist, 6) AS dist FROM c WHERE dist < 3.1 AND s > 0 AND degrees(acos(greatest(least(k / CASE WHEN s > 0 THEN s ELSE 1 END, 1), -1))) > 101""")
def hydrogen_bonds(spark, d):
    p = V.pts(spark, d)
    donors = p.where("atom % 3 = 0").select("frame", F.col("atom").alias("donor"), (F.col("atom") + 1).alias("hydrogen"))
    acceptors = p.where("atom % 3 = 2").select("frame", F.col("atom").alias("acceptor"))
    return structure.hydrogen_bonds(donors, acceptors, p, V.BOX, 3.1, 101.0).select("frame", "donor", "hydrogen", "acceptor", _r("dist"))


def _chain(p: DataFrame, n: int) -> DataFrame:
    """(frame, atomi, ...): ``n`` atoms in a row from each atom of a frame; ends past its last have no position."""
    return p.select("frame", *[(F.col("atom") + k).alias(f"atom{c}") for k, c in zip(range(n), "ijkl")])


def _step(a: str, b: str) -> str:
    return ", ".join(f"{b}.{c} - {a}.{c} - {l} * round_even(({b}.{c} - {a}.{c}) / {l}, 0) AS {c}{a}{b}" for c, l in zip("xyz", (50, 11, 9), strict=True))


_CHAIN = f"{V.PTS}, steps AS (SELECT i.frame, i.atom, {_step('i', 'j')}, {_step('j', 'k')}, {_step('k', 'l')} FROM pts i JOIN pts j ON j.frame = i.frame AND j.atom = i.atom + 1 LEFT JOIN pts k ON k.frame = i.frame AND k.atom = i.atom + 2 LEFT JOIN pts l ON l.frame = i.frame AND l.atom = i.atom + 3)"


@query(f"WITH {_CHAIN}, h AS (SELECT CAST(floor(sqrt(xij * xij + yij * yij + zij * zij) / (26.3 / 12)) AS INTEGER) AS bin, count(*) AS n FROM steps WHERE xij * xij + yij * yij + zij * zij < {26.3**2!r} GROUP BY 1) SELECT CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS count FROM range(12) LEFT JOIN h ON bin = range")
def distance_distribution(spark, d):
    p = V.written_pts(spark, d)
    return structure.value_distribution(structure.bond_lengths(_chain(p, 2), p, V.BOX), 12, 0.0, 26.3).select("bin", "count")


@query(f"""WITH {_CHAIN}, a AS (SELECT acos(greatest(least(-(xij * xjk + yij * yjk + zij * zjk) / s, 1), -1)) AS v FROM (SELECT *, sqrt((xij * xij + yij * yij + zij * zij) * (xjk * xjk + yjk * yjk + zjk * zjk)) AS s FROM steps) WHERE s > 0),
h AS (SELECT CAST(floor(v / (3.2 / 11)) AS INTEGER) AS bin, count(*) AS n FROM a GROUP BY 1) SELECT CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS count FROM range(11) LEFT JOIN h ON bin = range""")
def angle_distribution(spark, d):
    p = V.written_pts(spark, d)
    return structure.value_distribution(structure.bond_angles(_chain(p, 3), p, V.BOX), 11, 0.0, 3.2, sine=True).select("bin", "count")


@query(f"""WITH {_CHAIN}, n AS (SELECT *, yij * zjk - zij * yjk AS ax, zij * xjk - xij * zjk AS ay, xij * yjk - yij * xjk AS az, yjk * zkl - zjk * ykl AS bx, zjk * xkl - xjk * zkl AS by_, xjk * ykl - yjk * xkl AS bz FROM steps WHERE xkl IS NOT NULL),
s AS (SELECT sqrt(xjk * xjk + yjk * yjk + zjk * zjk) * (xij * bx + yij * by_ + zij * bz) AS s, ax * bx + ay * by_ + az * bz AS c FROM n),
v AS (SELECT atan2(CASE WHEN s = 0 THEN 0 ELSE s END, CASE WHEN c = 0 THEN 0 ELSE c END) AS v FROM s),
h AS (SELECT CAST(floor((v + 3.3) / (6.6 / 13)) AS INTEGER) AS bin, count(*) AS n FROM v GROUP BY 1) SELECT CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS count FROM range(13) LEFT JOIN h ON bin = range""")
def dihedral_distribution(spark, d):
    p = V.written_pts(spark, d)
    return structure.value_distribution(structure.torsions(_chain(p, 4), p, V.BOX), 13, -3.3, 3.3).select("bin", "count")


@query("""WITH b AS (SELECT CAST(floor((l_quantity - 0.5) / 12.5) AS INTEGER) AS b_l_quantity, CAST(floor((l_discount + 0.005) / 0.022) AS INTEGER) AS b_l_discount FROM lineitem)
SELECT CAST(p.range AS INTEGER) AS b_l_quantity, CAST(q.range AS INTEGER) AS b_l_discount, count(b.b_l_quantity) AS count FROM range(4) p CROSS JOIN range(5) q LEFT JOIN b ON b_l_quantity = p.range AND b_l_discount = q.range GROUP BY 1, 2""")
def combined_distribution(spark, d):
    return structure.combined_distribution(V.table(spark, d, "lineitem"), [("l_quantity", 4, 0.5, 50.5), ("l_discount", 5, -0.005, 0.105)])


@query(f"""WITH {V.PTS}, r AS (SELECT a.frame, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS r FROM pts a JOIN pts b ON a.frame = b.frame),
k AS (SELECT unnest([0.7, 2.1]) AS k) SELECT frame, CAST(k AS DOUBLE) AS k, round(sum(CASE WHEN r = 0 THEN 1 ELSE sin(k * r) / (k * r) END) / sqrt(count(*)), 5) AS s FROM r, k GROUP BY 1, 2""")
def structure_factor(spark, d):
    return structure.structure_factor(V.pts(spark, d), [0.7, 2.1]).select("frame", "k", _r("s", 5))


@query(f"WITH {V.WALKS}, o AS (SELECT frame, x - first_value(x) OVER (PARTITION BY particle ORDER BY frame) AS dx FROM walks) SELECT frame, round(avg(dx * dx), 4) AS msd, count(*) AS n FROM o GROUP BY 1")
def msd_direct(spark, d):
    return dynamics.msd_direct(V.walks(spark, d), ["x"]).select("frame", _r("msd", 4), "n")


@query(f"WITH {V.WALKS} SELECT CAST(l.range AS INTEGER) AS lag, round(avg(pow(b.x - a.x, 2)), 4) AS msd, count(*) AS n FROM walks a CROSS JOIN range(11) l JOIN walks b ON a.particle = b.particle AND b.frame = a.frame + l.range GROUP BY 1")
def msd_window(spark, d):
    return dynamics.msd_window(V.walks(spark, d), 10, ["x"]).select("lag", _r("msd", 4), "n")


@query(f"WITH {V.WALKS} SELECT CAST(l.range AS INTEGER) AS lag, round(avg(a.v * b.v), 4) AS acf, count(*) AS n FROM walks a CROSS JOIN range(11) l JOIN walks b ON a.particle = b.particle AND b.frame = a.frame + l.range GROUP BY 1")
def velocity_acf(spark, d):
    return dynamics.acf(V.walks(spark, d), ["v"], 10).select("lag", _r("acf", 4), "n")


@query(f"""WITH {V.WALKS}, m AS (SELECT l.lag, abs(b.x - a.x) AS r FROM walks a CROSS JOIN (SELECT unnest([1, 4, 9]) AS lag) l JOIN walks b ON a.particle = b.particle AND b.frame = a.frame + l.lag),
h AS (SELECT lag, CAST(floor(r / 25.0) AS INTEGER) AS bin, count(*) AS n FROM m WHERE r < 500 GROUP BY 1, 2), t AS (SELECT lag, count(*) AS n FROM m GROUP BY 1)
SELECT t.lag, CAST(b.range AS INTEGER) AS bin, coalesce(h.n, 0) AS count, round(coalesce(h.n, 0) / t.n / 25.0, 8) AS g FROM t CROSS JOIN range(20) b LEFT JOIN h ON h.lag = t.lag AND h.bin = b.range""")
def van_hove(spark, d):
    return dynamics.van_hove_self(V.walks(spark, d), 20, 500.0, [1, 4, 9], ["x"]).select("lag", "bin", "count", _r("g", 8))


@query(f"""WITH {V.WALKS}, u AS (SELECT particle, frame, v / sqrt(v * v + 900) AS p, 30 / sqrt(v * v + 900) AS q FROM walks), c AS (SELECT CAST(l.range AS INTEGER) AS lag, a.p * b.p + a.q * b.q AS c FROM u a CROSS JOIN range(6) l JOIN u b ON a.particle = b.particle AND b.frame = a.frame + l.range)
SELECT lag, round(avg(c), 6) AS c1, round(avg((3 * c * c - 1) / 2), 6) AS c2, count(*) AS n FROM c GROUP BY 1""")
def reorientation(spark, d):
    w = V.walks(spark, d).select("particle", "frame", F.col("v").alias("ux"), F.lit(30.0).alias("uy"), F.lit(0.0).alias("uz"))
    return dynamics.reorientation(w, 5).select("lag", _r("c1"), _r("c2"), "n")


_LAGGED = f"WITH {V.SERIES}, s AS (SELECT CAST(l.range AS INTEGER) AS lag, a.m, a.p, b.m AS m2, b.p AS p2 FROM series a CROSS JOIN range(9) l JOIN series b ON b.frame = a.frame + l.range)"


@query(f"{_LAGGED} SELECT lag, lag * 0.5 AS lag_time, round(avg((m2 - m) * (p2 - p)), 3) AS l FROM s GROUP BY 1, 2")
def onsager(spark, d):
    return dynamics.onsager(V.series(spark, d), ["m"], ["p"], 8, 0.5).select("lag", "lag_time", _r("l", 3))


@query(f"{_LAGGED} SELECT lag, lag * 0.5 AS lag_time, round(avg((m2 - m) * (m2 - m) + (p2 - p) * (p2 - p)), 3) AS msd FROM s GROUP BY 1, 2")
def einstein_conductivity(spark, d):
    return dynamics.einstein_conductivity(V.series(spark, d), ["m", "p"], 8, 0.5).select("lag", "lag_time", _r("msd", 3))


@query(f"{_LAGGED}, g AS (SELECT lag, avg(m * m2) AS y FROM s GROUP BY 1), t AS (SELECT lag, y, coalesce((y + lag(y) OVER (ORDER BY lag)) * 0.25, 0) AS t FROM g) SELECT lag, round(y, 3) AS jacf, round(sum(t) OVER (ORDER BY lag), 3) AS integral FROM t")
def green_kubo(spark, d):
    return dynamics.cumulative_trapezoid(dynamics.green_kubo_conductivity(V.series(spark, d), ["m"], 8, 0.5), "jacf", 0.5).select("lag", _r("jacf", 3), _r("integral", 3))


@query(f"WITH {V.WALKS}, m AS (SELECT CAST(l.range AS INTEGER) AS lag, avg(pow(b.x - a.x, 2)) AS msd FROM walks a CROSS JOIN range(11) l JOIN walks b ON a.particle = b.particle AND b.frame = a.frame + l.range GROUP BY 1) SELECT round(regr_slope(msd, lag), 3) AS slope, round(regr_intercept(msd, lag), 3) AS intercept, round(regr_r2(msd, lag), 6) AS r2, count(*) AS n FROM m WHERE lag BETWEEN 2 AND 8")
def linear_fit(spark, d):
    return dynamics.linear_fit(dynamics.msd_window(V.walks(spark, d), 10, ["x"]), "lag", "msd", 2 / 11, 9 / 11).select(_r("slope", 3), _r("intercept", 3), _r("r2"), "n")


@query(f"WITH {V.SERIES} SELECT round(var_pop(m) + var_pop(p), 4) AS variance FROM series")
def static_dielectric(spark, d):
    return dynamics.static_dielectric(V.series(spark, d), ["m", "p"], 1000.0, 300.0).select(_r("variance", 4))


@query(f"""WITH {V.WALKS}, b AS (SELECT *, CASE WHEN d > 60 OR lag(frame) OVER w IS NULL OR frame - lag(frame) OVER w > 1 THEN 1 ELSE 0 END AS cut FROM (SELECT particle, frame, abs(v) AS d FROM walks) WINDOW w AS (PARTITION BY particle ORDER BY frame)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY particle ORDER BY frame) AS island FROM b), f AS (SELECT *, max(CASE WHEN d < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY particle, island ORDER BY frame) AS formed FROM i),
k AS (SELECT particle, frame, island FROM f WHERE formed = 1 AND d <= 60), s AS (SELECT l.range AS lag, count(*) AS n FROM k a CROSS JOIN range(7) l JOIN k b ON a.particle = b.particle AND a.island = b.island AND b.frame = a.frame + l.range GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS lag, round(coalesce(n, 0) / (p.i * (p.f - r.range)), 6) AS c FROM range(7) r CROSS JOIN (SELECT count(DISTINCT particle) AS i, count(DISTINCT frame) AS f FROM walks) p LEFT JOIN s ON s.lag = r.range""")
def pair_survival(spark, d):
    dist = V.walks(spark, d).select(F.col("particle").alias("i"), F.lit(0).alias("j"), "frame", F.abs("v").alias("dist"))
    return dynamics.pair_survival(dist, None, None, 20.0, 60.0, 6).select("lag", _r("c"))


_CLUSTERS = f"""WITH RECURSIVE {V.pairs_sql(1.2)}, {V.WAYS}, reach AS (SELECT frame, atom AS a, atom AS b FROM pts UNION SELECT r.frame, r.a, w.j FROM reach r JOIN ways w ON r.frame = w.frame AND r.b = w.i),
members AS (SELECT frame, a AS atom, min(b) AS cluster FROM reach GROUP BY 1, 2)"""


def _clusters(p: DataFrame) -> DataFrame:
    return shape.clusters(neighbors.neighbor_pairs(p, V.BOX, 1.2), p)


@query(f"{_CLUSTERS} SELECT frame, atom, cluster FROM members")
def clusters(spark, d):
    return _clusters(V.written_pts(spark, d))


@query(f"{_CLUSTERS} SELECT frame, cluster, count(*) AS size FROM members GROUP BY 1, 2 HAVING count(*) >= 3")
def cluster_sizes(spark, d):
    return shape.cluster_sizes(_clusters(V.written_pts(spark, d)), 3)


@query(f"""{_CLUSTERS}, c AS (SELECT m.frame, cluster, count(*) AS n, sum(mass) AS mass, avg(x) AS cx, sum(mass * x) / sum(mass) AS mx, sum(mass * y) / sum(mass) AS my, sum(mass * z) / sum(mass) AS mz,
 sum(mass * (x * x + y * y + z * z)) / sum(mass) AS s FROM members m JOIN pts p ON m.frame = p.frame AND m.atom = p.atom GROUP BY 1, 2)
SELECT frame, cluster, n, mass, round(cx, 6) AS cx, round(mx, 6) AS mx, round(sqrt(greatest(s - mx * mx - my * my - mz * mz, 0)), 3) AS rg FROM c""")
def cluster_properties(spark, d):
    p = V.written_pts(spark, d)
    rows = _clusters(p).join(p, ["frame", "atom"])
    return shape.moments(rows, ["frame", "cluster"], F.col("mass")).select("frame", "cluster", "n", "mass", _r("cx"), _r("mx"), _r("rg", 3))


@query(f"WITH {V.PTS} SELECT frame, round(var_pop(x), 4) AS gxx, round(covar_pop(x, y), 4) AS gxy, round(var_pop(z), 4) AS gzz, round(var_pop(x) + var_pop(y) + var_pop(z), 4) AS trace FROM pts GROUP BY 1")
def gyration_tensor(spark, d):
    found = shape.shape_descriptors(shape.moments(V.pts(spark, d), ["frame"]))
    low, mid, high = shape.principal_values()
    return found.withColumn("trace", low + mid + high).select("frame", _r("gxx", 4), _r("gxy", 4), _r("gzz", 4), _r("trace", 4))


@query(f"WITH {V.PTS} SELECT frame, round(sum(mass * (y * y + z * z)) - pow(sum(mass * y), 2) / sum(mass) - pow(sum(mass * z), 2) / sum(mass), 2) AS ixx, round(sum(mass * x) * sum(mass * y) / sum(mass) - sum(mass * x * y), 2) AS ixy FROM pts GROUP BY 1")
def inertia_tensor(spark, d):
    return shape.moments(V.pts(spark, d), ["frame"], F.col("mass")).select("frame", _r("ixx", 2), _r("ixy", 2))


@query(f"WITH {V.GRAPH} SELECT p.b AS atomi, p.a AS atomj, q.b AS atomk FROM edges p JOIN edges q ON p.a = q.a AND p.b < q.b")
def angle_perception(spark, d):
    return graph.angles(V.graph(spark, d))


@query(f"""WITH {V.GRAPH} SELECT i.b AS atomi, m.a AS atomj, m.b AS atomk, l.b AS atoml FROM edges m JOIN edges i ON i.a = m.a AND i.b <> m.b JOIN edges l ON l.a = m.b AND l.b <> m.a AND l.b <> i.b WHERE m.a < m.b""")
def dihedral_perception(spark, d):
    return graph.dihedrals(V.graph(spark, d))


@query(f"""WITH RECURSIVE {V.GRAPH}, walk AS (SELECT CAST(0 AS BIGINT) AS atom, 0 AS hops UNION SELECT b, hops + 1 FROM walk JOIN edges ON atom = a WHERE hops < 3) SELECT atom, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY 1""")
def hop_distances(spark, d):
    return graph.hop_distances(V.graph(spark, d), spark.createDataFrame([(0,)], "atom long"), 3)


@query(f"WITH {V.GRAPH}, c AS (SELECT atomi AS atom, atomj AS component FROM graph WHERE atomj < 100) SELECT atom AS node, component FROM c UNION SELECT component, component FROM c UNION SELECT g.atomi, c.component FROM graph g JOIN c ON g.atomj = c.atom")
def molecules(spark, d):
    return components.connected_components(V.graph(spark, d), "atomi", "atomj")


@query(f"WITH {V.WALKS}, i AS (SELECT particle, frame, floor((time - first_value(time) OVER w) / 4e11) - frame AS d FROM walks WINDOW w AS (PARTITION BY particle ORDER BY frame)) SELECT particle, frame, CAST(frame + min(d) OVER (PARTITION BY particle ORDER BY frame) AS INTEGER) AS segment FROM i")
def split_by_time(spark, d):
    return trajectory.split_by_time(V.walks(spark, d), 4e11, ["particle"]).select("particle", "frame", "segment")


@query(f"WITH {V.WALKS} SELECT particle, frame, CAST(frame // 7 AS INTEGER) AS segment FROM walks WHERE frame >= 2 AND frame < 60 AND (frame - 2) % 3 = 0")
def frame_slices(spark, d):
    return trajectory.split_by_frames(trajectory.frame_slice(V.walks(spark, d), 2, 60, 3), 7).select("particle", "frame", "segment")


_PATTERNS = [("exact", ["Brand#11", "Brand#11"], 0, 0), ("half", ["Brand#11", "*"], 0, 1), ("class", ["Brand#1", "Brand#2"], 0, 2), ("other", ["Brand#1", "Brand#2"], 1, 3), ("any", ["*", "*"], 0, 4), ("late", ["*", "*"], 0, 5)]


@query("""WITH t AS (SELECT p_partkey AS term, p_brand AS a, CASE WHEN p_size % 9 = 0 THEN NULL ELSE 'Brand#' || (1 + p_size % 3) || (1 + p_size % 2) END AS b FROM part),
p(name, x, y, layer, ord) AS (VALUES ('exact', 'Brand#11', 'Brand#11', 0, 0), ('half', 'Brand#11', '*', 0, 1), ('class', 'Brand#1', 'Brand#2', 0, 2), ('other', 'Brand#1', 'Brand#2', 1, 3), ('any', '*', '*', 0, 4), ('late', '*', '*', 0, 5)),
s AS (SELECT term, name, layer, ord, CASE WHEN u = x THEN 3 WHEN left(u, 7) = x THEN 1 WHEN x = '*' THEN 0 END + CASE WHEN v = y THEN 3 WHEN left(v, 7) = y THEN 1 WHEN y = '*' THEN 0 END AS score
  FROM (SELECT term, a AS u, b AS v FROM t UNION ALL SELECT term, b, a FROM t) CROSS JOIN p WHERE u IS NOT NULL AND v IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, layer DESC, ord) AS k FROM s WHERE score IS NOT NULL)
SELECT t.term, r.name, r.score FROM t LEFT JOIN r ON r.term = t.term AND r.k = 1""")
def best_match(spark, d):
    size = F.col("p_size")
    b = F.when(size % 9 != 0, F.concat(F.lit("Brand#"), (1 + size % 3).cast("string"), (1 + size % 2).cast("string")))
    terms = V.table(spark, d, "part").select(F.col("p_partkey").alias("term"), F.col("p_brand").alias("a"), b.alias("b"))
    types = terms.select(F.explode(F.array("a", "b")).alias("type")).where("type is not null").distinct()
    patterns = spark.createDataFrame(_PATTERNS, "name string, comp array<string>, layer int, ord int")
    return forcefield.match_terms(terms, ["a", "b"], types.withColumn("class", F.substring("type", 1, 7)), patterns).select("term", "name", "score")


@query(f"WITH {V.pairs_sql(2.3)} SELECT frame, round(sum(4 * 0.3 * (pow(1.1 / dist, 12) - pow(1.1 / dist, 6))), 4) AS energy FROM pairs WHERE dist > 0 GROUP BY 1")
def lennard_jones(spark, d):
    energy = forcefield.lennard_jones(F.col("dist"), F.lit(0.3), F.lit(1.1))
    return forcefield.pair_energy(_pairs(spark, d, 2.3).where("dist > 0"), energy).select("frame", _r("energy", 4))


@query(f"""WITH {V.pairs_sql(2.3)}, {V.WAYS} SELECT frame, i AS atom, round(sum(0.5 * (dist - 2.3) * 2 * dx / dist), 4) + 0.0 AS fx, round(sum(0.5 * (dist - 2.3) * 2 * dz / dist), 4) + 0.0 AS fz FROM ways WHERE dist > 0 GROUP BY 1, 2""")
def pair_forces(spark, d):
    return forcefield.pair_forces(_pairs(spark, d, 2.3), F.col("dist") - 2.3).select("frame", "atom", _r("fx", 4), _r("fz", 4))


@query(f"""WITH {V.pairs_sql(2.3)}, every AS (SELECT frame, i, j, sqrt(dx * dx + dy * dy + dz * dz) AS dist FROM diff)
SELECT frame, round(sum(CASE WHEN j = i + 1 THEN 0.5 * 2.0 * pow(dist - 1.5, 2) ELSE 0.5 * 3.0 * pow(2.2 - least(dist, 2.2), 2) END), 4) AS energy FROM every WHERE dist IS NOT NULL AND (j = i + 1 OR dist < 2.2) GROUP BY 1""")
def soft_potential(spark, d):
    """Each bond of a chain has a spring, however long it is; of other pairs the near ones push."""
    p, at = V.written_pts(spark, d), lambda e: tuple(f"{c}_{e}" for c in "xyz")
    first = p.select("frame", F.col("atom").alias("atomi"), (F.col("atom") + 1).alias("atomj"), *[F.col(c).alias(e) for c, e in zip("xyz", at("atomi"), strict=True)])
    # both sides hold all atoms, so neither is to be sent to all tasks
    bonds = structure.with_positions(first, p.hint("merge"), ["atomj"]).select("frame", "atomi", "atomj", V.BOX.distance(at("atomi"), at("atomj")).alias("dist"), F.lit(1.5).alias("r0"))
    bonds = materialize(bonds.where("dist is not null"), "bonds")
    near = graph.exclude_bonded(neighbors.neighbor_pairs(p, V.BOX, 2.3), bonds.where("dist < 2.4"))  # longer ones are no near pairs
    return forcefield.soft_potential(bonds, near, 2.0, 3.0, 2.2).select("frame", _r("energy", 4))


@query("""WITH n AS (SELECT CAST(ceil(cbrt(max(s_suppkey) + 1)) AS BIGINT) AS n FROM supplier), c AS (SELECT s_suppkey AS id, s_nationkey AS nation, s_suppkey % n AS a, s_suppkey // n % n AS b, s_suppkey // (n * n) AS c FROM supplier, n)
SELECT id * 4 + s.k AS atom, nation, round(CAST(5.26 * (a + s.u) AS DOUBLE), 6) AS x, round(CAST(5.26 * (b + s.v) AS DOUBLE), 6) AS y, round(CAST(5.26 * (c + s.w) AS DOUBLE), 6) AS z
FROM c, (VALUES (0, 0, 0, 0), (1, 0.5, 0.5, 0), (2, 0.5, 0, 0.5), (3, 0, 0.5, 0.5)) s(k, u, v, w)""")
def fcc_crystal(spark, d):
    """A cell for each supplier's number, whose nation its atoms are of."""
    suppliers = V.table(spark, d, "supplier")
    n = suppliers.agg(F.ceil(F.cbrt(F.max("s_suppkey") + 1)).alias("n")).first()["n"]
    cell = [[5.26, 0, 0], [0, 5.26, 0], [0, 0, 5.26]]
    atoms = generators.build_crystal(spark, cell, generators.lattice_basis("fcc"), (n, n, n)).withColumn("s_suppkey", F.floor(F.col("atom") / 4))
    return atoms.join(suppliers.select("s_suppkey", F.col("s_nationkey").alias("nation")), "s_suppkey").select("atom", "nation", *[_r(c) for c in "xyz"])


@query("""WITH RECURSIVE o AS (SELECT s_suppkey AS species, s_suppkey % 10 AS u, s_nationkey % 10 AS v, s_suppkey // 10 % 10 AS w FROM supplier
UNION SELECT species, CASE WHEN k IN (0, 1, 3) THEN 10 - u WHEN k = 2 THEN w WHEN k = 4 THEN u + 5 ELSE u END % 10,
 CASE WHEN k IN (0, 3) THEN 10 - v WHEN k = 2 THEN u WHEN k IN (4, 5) THEN v + 5 ELSE v END % 10,
 CASE WHEN k IN (1, 3) THEN 10 - w WHEN k = 2 THEN v WHEN k = 5 THEN w + 5 ELSE w END % 10 FROM o, range(6) g(k))
SELECT species, u / 10.0 AS u, v / 10.0 AS v, w / 10.0 AS w FROM o""")
def space_group(spark, d):
    """A site for each supplier, at tenths of the cell that its keys give."""
    tenth = lambda c: (F.expr(c) % 10 / 10).cast("double")
    sites = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("species"), tenth("s_suppkey").alias("u"), tenth("s_nationkey").alias("v"), tenth("s_suppkey div 10").alias("w"))
    return generators.equivalent_positions(sites, ["-x,-y,z", "-x,y,-z", "z,x,y", "-x,-y,-z", "x+1/2,y+1/2,z", "x,y+1/2,z+1/2"])


@query("""WITH c AS (SELECT o_orderkey AS chain, o_totalprice AS value, sum(o_totalprice) OVER (ORDER BY o_orderkey) AS cumulative FROM orders) SELECT chain, round(cumulative, 2) AS cumulative FROM c WHERE cumulative - value < 5e8 AND cumulative <= 5e8 * 1.02""")
def system_planner(spark, d):
    return generators.plan_system(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("chain"), F.col("o_totalprice").alias("value")), 5e8).select("chain", _r("cumulative", 2))


@query(f"WITH {V.PTS} SELECT frame, atom FROM pts WHERE (type = 'A' AND x BETWEEN 3 AND 20) OR (NOT z >= 2 AND sqrt(pow(x - 25, 2) + pow(y - 5, 2) + pow(z - 4, 2)) BETWEEN 2.5 AND 6.5)")
def selectors(spark, d):
    s = predicates
    chosen = (s.by_type("A") & s.coordinate_range("x", 3, 20)) | (~s.coordinate_range("z", low=2) & s.within((25, 5, 4), 6.5, 2.5))
    return V.pts(spark, d).where(chosen).select("frame", "atom")


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 40 AS x, CAST(embedding[2] AS DOUBLE) * 40 AS y, CAST(embedding[3] AS DOUBLE) * 40 AS z FROM embeddings)
SELECT vec_id, round(x - 7 * floor((x + 1) / 7), 4) AS wx, round(y - 5 * floor((y - 2) / 5), 4) AS wy, round(z, 4) AS wz, CAST(floor((x + 1) / 7) AS BIGINT) AS ix, round(sqrt(pow(x - y - 7 * round((x - y) / 7), 2) + pow(y - z - 5 * round((y - z) / 5), 2) + pow(z - x, 2)), 4) AS dist FROM p""")
def box_wrap(spark, d):
    e = F.col("embedding")
    p = V.table(spark, d, "embeddings").select("vec_id", *[(e[k].cast("double") * 40).alias(c) for k, c in enumerate("xyz")])
    box = Box.orthogonal(7, 5, 3, pbc=(True, True, False), origin=(-1, 2, 0))
    w, i = box.wrap(("x", "y", "z")), box.images(("x", "y", "z"))
    return p.select("vec_id", *[F.round(v, 4).alias(f"w{c}") for v, c in zip(w, "xyz")], i[0].alias("ix"), F.round(box.distance(("x", "y", "z"), ("y", "z", "x")), 4).alias("dist"))


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 9 AS x, CAST(embedding[2] AS DOUBLE) * 9 AS y, CAST(embedding[3] AS DOUBLE) * 9 AS z FROM embeddings), f AS (SELECT vec_id, x, y, z, z / 3 AS w, (y - 0.5 * z / 3) / 5 AS v FROM p), g AS (SELECT *, (x - 2 * v - w) / 7 AS u FROM f)
SELECT vec_id, round(u, 5) AS u, round(v, 5) AS v, round(w, 5) AS w, round(x - 7 * floor(u) - 2 * floor(v) - floor(w), 4) AS wx FROM g""")
def triclinic_box(spark, d):
    e = F.col("embedding")
    p = V.table(spark, d, "embeddings").select("vec_id", *[(e[k].cast("double") * 9).alias(c) for k, c in enumerate("xyz")])
    box = Box.triclinic((7, 5, 3), (2, 1, 0.5))
    return p.select("vec_id", *[(F.round(f, 5) + 0.0).alias(n) for f, n in zip(box.fractional(("x", "y", "z")), "uvw")], F.round(box.wrap(("x", "y", "z"))[0], 4).alias("wx"))


@query("SELECT CAST(r.range AS INTEGER) AS bin, count(l_extendedprice) AS count FROM range(30) r LEFT JOIN lineitem ON l_extendedprice >= r.range * 5000.0 AND l_extendedprice < (r.range + 1) * 5000.0 GROUP BY 1")
def histogram_1d(spark, d):
    return histogram(V.table(spark, d, "lineitem"), F.col("l_extendedprice"), 30, 0.0, 150000.0).select("bin", "count")


@query(f"WITH {V.PTS} SELECT frame, type, round(sum(mass * x), 4) AS x, round(sum(mass * y), 4) AS y FROM pts GROUP BY 1, 2")
def collective_sums(spark, d):
    return dynamics.collective(V.pts(spark, d), "mass", ["x", "y"], ["frame", "type"]).select("frame", "type", _r("x", 4), _r("y", 4))




@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM e),
v AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l FROM m), u AS (SELECT *, b / sqrt(b * b + pow(l - a, 2)) AS p, (l - a) / sqrt(b * b + pow(l - a, 2)) AS q FROM v),
d AS (SELECT vec_id, pow((x - mx) * p + (y - my) * q, 2) AS s1, pow((y - my) * p - (x - mx) * q, 2) AS s2 FROM e, u) SELECT vec_id, round(s1, 6) AS s1, round(s2, 6) AS s2 FROM d""")
def pca_plane(spark, d):
    """Squares, as a component has no sign of its own; two columns have their axes in closed form."""
    e = V.table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(2)])
    found = shape.pca(e, ["e0", "e1"])[0].withColumns({"s1": F.col("pc1") * F.col("pc1"), "s2": F.col("pc2") * F.col("pc2")})
    return found.select("vec_id", _r("s1"), _r("s2"))


@query()
def pca(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(8)])
    return shape.pca(e, [f"e{k}" for k in range(8)])[0].select("vec_id", "pc1", "pc2")


@query()
def kmeans(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(8)])
    return shape.kmeans(e, [f"e{k}" for k in range(8)], 10).select("vec_id", "label")


@query()
def chain_lengths(spark, d):
    """A chain mass of a Schulz-Zimm distribution for each order, seeded."""
    return generators.sample_chains(spark, V.table(spark, d, "orders").count(), lambda rng, n: rng.gamma(2.0, 500.0, n), seed=7)
