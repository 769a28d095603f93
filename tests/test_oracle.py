"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import pytest

import oracle
from marginalia import plans

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows(spark, con, name):
    assert oracle.compare(spark, con, SF, QUERIES[name], ORACLE[name]) >= 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns and QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
