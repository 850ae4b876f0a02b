"""Registered queries of sites that are added to atoms as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.operators import virtual_sites
from motefield.plans import views as V
from motefield.plans.registry import query, rounded


@query(f"""WITH {V.PTS}, k AS (SELECT * FROM (VALUES ('A', 1.0::DOUBLE, 4184.0::DOUBLE, 0.4::DOUBLE), ('N', 2.0, 0.0, 0.4), ('R', 0.5, 2092.0, 0.2)) t(type, alpha, spring, m)),
p AS (SELECT pts.*, y - 5 AS charge, (SELECT max(atom) + 1 FROM pts) AS shift, -sqrt(alpha * spring / 1389.35458) AS q, m FROM pts LEFT JOIN k ON k.type = pts.type AND spring > 0)
SELECT frame, CAST(atom AS BIGINT) AS atom, type, round(charge - coalesce(q, 0), 6) AS charge, round(mass - coalesce(m, 0), 6) AS mass, x, y, z FROM p UNION ALL
SELECT frame, CAST(atom + shift AS BIGINT), 'D' || type, round(q, 6), m, x, y, z FROM p WHERE q IS NOT NULL""")
def drude_particles(spark, d):
    """Shells on the lines that are A or R, of a spring each; all rows of all frames."""
    atoms = V.pts(spark, d).withColumn("charge", F.col("y") - 5)
    is_ = lambda a, r: F.when(F.col("type") == "A", a).when(F.col("type") == "R", r)
    kinds = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("type")).distinct()
    kinds = kinds.select("type", is_(1.0, 0.5).alias("alpha"), is_(4184.0, 2092.0).alias("spring"), is_(0.4, 0.2).alias("shell_mass"))
    found, _ = virtual_sites.drude_particles(atoms, kinds)
    return found.select("frame", "atom", "type", rounded("charge"), rounded("mass"), "x", "y", "z")


@query(f"""WITH {V.PTS}, o AS (SELECT a.frame, a.atom, a.x, a.y, a.z, b.x + c.x - 2 * a.x AS u, b.y + c.y - 2 * a.y AS v, b.z + c.z - 2 * a.z AS w, a.x - 25 AS q
FROM pts a JOIN pts b ON b.frame = a.frame AND b.atom = a.atom + 1 JOIN pts c ON c.frame = a.frame AND c.atom = a.atom + 2 WHERE a.atom % 3 = 0),
s AS (SELECT *, CASE WHEN u * u + v * v + w * w > 0 THEN sqrt(u * u + v * v + w * w) ELSE 1 END AS r, (SELECT max(atom) + 1 FROM pts) AS shift FROM o)
SELECT pts.frame, CAST(pts.atom AS BIGINT) AS atom, CASE WHEN pts.atom % 3 = 0 THEN 'O' ELSE 'H' END AS element, CASE WHEN s.atom IS NULL THEN pts.x - 25 ELSE 0 END AS charge, pts.x, pts.y, pts.z
FROM pts LEFT JOIN s ON s.frame = pts.frame AND s.atom = pts.atom UNION ALL
SELECT frame, CAST(atom + shift AS BIGINT), 'M', q, round(x + u / r * 0.15, 6), round(y + v / r * 0.15, 6), round(z + w / r * 0.15, 6) FROM s""")
def bisector_sites(spark, d):
    """A supplier's lines by threes as an oxygen and its hydrogens; the last may lack one."""
    at = F.col("atom") % 3
    atoms = V.pts(spark, d).select("frame", "atom", F.when(at == 0, "O").otherwise("H").alias("element"), (F.col("x") - 25).alias("charge"), "x", "y", "z")
    bonds = atoms.where(at > 0).select("frame", (F.col("atom") - at).alias("atomi"), F.col("atom").alias("atomj"))
    found, _ = virtual_sites.bisector_sites(atoms, bonds, 0.15)
    return found.select("frame", "atom", "element", "charge", rounded("x"), rounded("y"), rounded("z"))
