"""Every query with SQL against DuckDB, and every other one for rows and a stable schema, at the smallest size."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from quietfield import queries as signal

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(signal.ORACLE_SQL))
def test_against_sql(spark, con, name):
    got, want = signal.QUERIES[name](spark, str(DATA)).toPandas(), con.execute(signal.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    cols = sorted(got.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), atol=2e-3, rtol=1e-9)
        else:
            assert list(a[c]) == list(b[c]), c


@pytest.mark.parametrize("name", sorted(set(signal.QUERIES) - set(signal.ORACLE_SQL)))
def test_runs(spark, name):
    assert signal.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
