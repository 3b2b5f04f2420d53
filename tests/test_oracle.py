"""Every registered job against its DuckDB oracle on the sf0.01 tables
(the driver's correctness gate, run locally)."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from salesloom.plans import registry
from tools.check_oracle import TABLES, _rows

SF = "/root/testdata/sf0.01"
JOBS = registry.jobs()
ORACLES = registry.oracles()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    yield c
    c.close()


def test_every_job_has_an_oracle_or_is_rows_only():
    rows_only = set(JOBS) - set(ORACLES)
    assert rows_only == set()
    assert set(ORACLES) <= set(JOBS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    sdf = JOBS[name](spark, SF)
    s_rows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(ORACLES[name])
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _rows(sdf.columns, s_rows) == _rows(d_cols, d_rows)


def test_entry_serves_every_job():
    assert set(JOBS) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 20
    assert df.columns[-1] == "ORDER_AGE_DAYS"
