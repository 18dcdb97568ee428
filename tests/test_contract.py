"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from survey_queries.check import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        verdict = compare(df, con, ORACLES[name])
        assert verdict in ("", "no rows"), verdict
    else:
        assert df.count() > 0
