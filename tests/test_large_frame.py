"""Queries on a frame of more atoms than any of the given tables has, against their SQL."""

import random

import duckdb
import pandas as pd
import pytest

from motefield.plans import catalogue
from tests.test_catalogue import told

ATOMS = {1: 5600, 2: 40}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, rows = random.Random(5), []
    for supplier, n in ATOMS.items():
        for k in range(n):
            rows.append((1000 * supplier + k // 4, k % 4 + 1, rng.randrange(200), supplier, float(rng.randrange(1, 51)), 900.0 + k, rng.randrange(11) / 100, rng.randrange(9) / 100, rng.choice("ANR"), "O", "1995-01-01"))
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    out = tmp_path_factory.mktemp("large")
    pd.DataFrame(rows, columns=columns).to_parquet(out / "lineitem.parquet")
    return out


@pytest.mark.parametrize("name", ["hydrogen_bonds", "distance_distribution", "angle_distribution", "dihedral_distribution", "soft_potential"])
def test_no_atom_is_left_out(spark, folder, name):
    found = catalogue.QUERIES[name](spark, str(folder))
    columns = sorted(found.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    want = sorted(tuple(told(v) for v in row) for row in con.sql(catalogue.ORACLE_SQL[name]).select(*columns).fetchall())
    assert sorted(tuple(told(v) for v in row) for row in found.select(*columns).collect()) == want
