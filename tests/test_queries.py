"""Every query of the reference's operators against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import numpy as np
import pytest

from tokenecho.plans import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        out.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return out


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, np.ndarray)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in catalog.ORACLES:
        return
    sql = con.sql(catalog.ORACLES[name])
    assert sorted(sql.columns) == names
    at = [sql.columns.index(c) for c in names]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)
