"""Pairs at the cutoff itself, and bonds longer than it."""

import math

import duckdb
import pandas as pd
import pytest

from motefield.functions.box import Box
from motefield.operators import neighbors
from motefield.plans import catalogue

FREE = Box(((0.0, 0.0, 0.0),) * 3, (False, False, False))
BELOW = math.nextafter(1.0, 0.0)  # 2 - BELOW is rounded to 1


@pytest.mark.parametrize(
    ("box", "cutoff", "places"),
    [
        (Box.orthogonal(50.0, 11.0, 9.0), 1.0, [28.0, 29.0, 30.0, 31.0]), (Box.orthogonal(49.0, 11.0, 9.0), 1.0, [2.0, 3.0, 4.0, 5.0, 8.0, 9.0]), (Box.cubic(49.0), 0.1, [12.4, 12.5]),
        (Box.orthogonal(49.0, 9.0, 9.0, pbc=(False, True, True)), 1.0, [2.0, 3.0, 4.0, 5.0]), (FREE, 1.0, [BELOW, 2.0]),
    ],
)
def test_pairs_at_the_cutoff(spark, box, cutoff, places):
    """Rounded, the cells of two points a cutoff apart lay two apart, and the pair was lost."""
    atoms = spark.createDataFrame([(0, k, x, 1.0, 1.0) for k, x in enumerate(places)], "frame int, atom long, x double, y double, z double")
    want = sorted((i, j) for i, p in enumerate(places) for j, q in enumerate(places) if i < j and abs(q - p) <= cutoff)
    assert want and sorted((r.i, r.j) for r in neighbors.neighbor_pairs(atoms, box, cutoff).collect()) == want
    assert sorted((r.i, r.j) for r in neighbors.cross_pairs(atoms, atoms, box, cutoff).where("i < j").collect()) == want


def test_every_bond_has_its_spring(spark, tmp_path):
    """A bond longer than the cutoff of near pairs had none. Frame 1: bonds of 10 and 2, across the box, and no near pair
    else; frame 2: bonds of 1 and 1, the ends 2 apart."""
    rows = [(1, k, 1, 1, x, 900.0, 0.0, 0.0, "A", "O", "1995-01-01") for k, x in enumerate((40.0, 50.0, 2.0), 1)]
    rows += [(2, k, 1, 2, x, 900.0, 0.0, 0.0, "A", "O", "1995-01-01") for k, x in enumerate((1.0, 2.0, 3.0), 1)]
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    pd.DataFrame(rows, columns=columns).to_parquet(tmp_path / "lineitem.parquet")
    want = {1: 8.5**2 + 0.5**2, 2: 2 * 0.5**2 + 1.5 * 0.2**2}
    assert {r.frame: r.energy for r in catalogue.QUERIES["soft_potential"](spark, str(tmp_path)).collect()} == pytest.approx(want, abs=1e-4)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert dict(con.sql(catalogue.ORACLE_SQL["soft_potential"]).fetchall()) == pytest.approx(want, abs=1e-4)
