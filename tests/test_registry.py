"""Driver contract: entry() runs; every registered query matches its SQL twin
on DuckDB (tiny scale here; the driver checks sf0.01)."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import duck, rows  # noqa: E402

BASE = "/root/testdata/sf0.001"
# the training-data queries have their own tests
QUERIES = {k: v for k, v in E.queries().items() if not re.match(r"op\d+_|pipeline$", k)}
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


def test_entry_runs_and_is_deterministic(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"id", "type", "severity", "product_id", "sku", "title", "message", "occurred_at"}
    first = sorted(tuple(r) for r in df.collect())
    assert first and first == sorted(tuple(r) for r in E.entry(spark).collect())


def test_every_query_has_sql_or_is_known():
    assert set(ORACLE) == set(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(BASE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, BASE).toPandas()
    want = con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
