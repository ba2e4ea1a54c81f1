import pytest

from spanloom.plans import catalog, core_problems, ingested, profiled
from tests.conftest import SMALL
from tests.oracle import connect, same

ORACLE = core_problems.ORACLE | catalog.ORACLE | ingested.ORACLE | profiled.ORACLE
QUERIES = core_problems.QUERIES | catalog.QUERIES | ingested.QUERIES | profiled.QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, name):
    same(QUERIES[name](spark, SMALL), ORACLE[name], con)


#: Queries whose tables hold none of what they report; their operators are tested on fixtures.
NONE_THERE = {"evidence_links", "otlp_issues"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_without_sql_have_rows(spark, name):
    n = QUERIES[name](spark, SMALL).count()
    assert (n == 0) == (name in NONE_THERE), n


def test_entry_is_complete(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
