import os

import pytest

from cotejo.llm import plans
from tests.oracle import ROOT, compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
COLUMNS = {
    "p1_found": ["fuente", "clave", "subclave"], "p2_found": ["id"], "p4_found": ["correccion_id"], "p6_found": ["estrato", "banda"],
    "p7_found": ["doc_id", "item_id"], "p8_found": ["source"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, name):
    compare(spark, connect(), plans.QUERIES[name], plans.SQL[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_as_stated(spark, name):
    assert sorted(plans.QUERIES[name](spark, ROOT).columns) == sorted(COLUMNS[name])


def test_sample_meets_its_report(spark):
    rep = plans.p6_report(spark, ROOT).collect()
    assert len(rep) == 12 and all(r.short or abs(r.off) < 1 for r in rep)


def test_mix_shares(spark):
    rows = plans.p8_shares(spark, ROOT).collect()
    assert abs(sum(r.share for r in rows) - 1) < 1e-6 and all(r.most_copies <= r.repeats for r in rows)


def test_quickstart(spark):
    distinct = plans._candidates(spark, ROOT).select("id", "palabras", *plans.SCALARS).distinct()
    assert plans.p2_quickstart(spark, ROOT).count() == min(200, distinct.count())
