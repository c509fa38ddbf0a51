"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

from framegate.plans.registry import oracles, queries

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
NAMES = list(queries())
SQL = oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        verdict = compare(df, con, SQL[name])
        assert verdict.startswith("EXACT"), verdict
    else:
        assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(queries())
