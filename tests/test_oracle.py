"""Every query with an oracle: Spark result equals the DuckDB SQL result at sf0.001
(row count, column names, multiset of rows; floats to 9 significant digits)."""

from __future__ import annotations

import os

import duckdb
import pytest

from shiprisk.plans import catalog
from shiprisk.sources.testdata import TABLES
from tests.conftest import SMOKE
from tools.oracle_check import _rows

catalog.load_all()
NAMES = sorted(catalog.ORACLE)


@pytest.fixture(scope="module")
def con():
    if not os.path.exists(f"{SMOKE}/lineitem.parquet"):
        pytest.skip("test data not present")
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SMOKE}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield c
    c.close()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = con.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    cols = sorted(got.columns)
    assert _rows(got, cols, 9) == _rows(want, cols, 9)


def test_every_query_is_registered_with_a_callable():
    assert len(catalog.QUERIES) >= 100
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
