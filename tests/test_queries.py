import os

import pytest

from cotejo.plans import campaign, corpus, general, report, stats
from tests.oracle import ROOT, compare, connect

MODULES = (campaign, corpus, general, report, stats)
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


def test_names():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) == sum(len(m.QUERIES) for m in MODULES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    compare(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, ROOT).columns


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 4 and set(e.oracle_sql()) <= set(e.queries())
