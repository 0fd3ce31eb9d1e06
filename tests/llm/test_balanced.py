import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cotejo.llm import balanced as B


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=40), st.integers(0, 99))
def test_flight_keeps_totals(units, seed):
    pi = np.array([u[0] for u in units])
    rows = B._one_hot(np.array([u[1:] for u in units]))
    out = B.flight(pi, rows, np.random.default_rng(seed))
    assert np.allclose(rows.T @ out, rows.T @ pi, atol=1e-6)
    assert ((out > 0) & (out < 1)).sum() <= rows.shape[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.floats(0.01, 0.99)), max_size=60), st.booleans(), st.integers(0, 99))
def test_batch_flight_keeps_totals(units, even, seed):
    cells = np.array([u[0] for u in units], dtype=int)
    pi = np.array([0.1 + 0.17 * u[0] if even else u[1] for u in units])
    out = B.batch_flight(pi, cells, np.random.default_rng(seed))
    for c in set(cells.tolist()):
        mine = out[cells == c]
        assert abs(mine.sum() - pi[cells == c].sum()) < 1e-6 and ((mine > 0) & (mine < 1)).sum() <= 1


def test_batch_flight_keeps_expectations():
    pi, cells = np.full(10, 0.33), np.zeros(10, dtype=int)
    mean = np.mean([B.batch_flight(pi, cells, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(mean - 0.33).max() < 0.03


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 300), st.integers(0, 99))
def test_landing_keeps_the_number(n, seed):
    rng = np.random.default_rng(seed)
    pi, codes = rng.random(n), rng.integers(0, [[9, 40]], (n, 2))
    out = B.land(pi, codes, rng)
    assert set(out) <= {0.0, 1.0} and abs(out.sum() - pi.sum()) < 1 + 1e-6


def make(spark, n=3000):
    rows = [(i, "ab"[i % 2] if i % 50 else None, "xyz"[0 if i % 3 else i % 7 % 3], "pi") for i in range(n)]
    return spark.createDataFrame(rows, "id int, e string, b string, pi string").repartition(5)


QUOTAS = [("a", "x", 0.5, 2), ("a", "y", 0.1, 2), ("b", "x", 0.305, 2), ("b", "z", 0.0, 5), ("c", "x", 0.1, 1), ("b", "y", 0.9, 0)]


def test_sample_and_report(spark):
    records, quotas = make(spark), spark.createDataFrame(QUOTAS, "e string, b string, p double, m int")
    sample, report = B.quota_sample(records, ["e", "b"], quotas, "p", "m", 333.0)
    rows, rep = sample.collect(), {(r.e, r.b): r for r in report.collect()}
    assert sample.columns == records.columns and len({r.id for r in rows}) == len(rows)
    for e, b, p, m in QUOTAS:
        r, here = rep[(e, b)], sum((x.e, x.b) == (e, b) for x in rows)
        want = max(m, p * 333)
        assert r.drawn == here and r.wanted == want and r.short == (r.available < want)
        assert abs(here - min(want, r.available)) < 1
    assert rep[("c", "x")].short and rep[("c", "x")].drawn == 0
    assert {r.id for r in B.quota_sample(records, ["e", "b"], quotas, "p", "m", 333.0, seed=12)[0].collect()} != {r.id for r in rows}


def test_landing_on_margins(spark):
    quotas = spark.createDataFrame([(e, b, 0.0517, 0) for e in "ab" for b in "xyz"], "e string, b string, p double, m int")
    rep = B.quota_sample(make(spark), ["e", "b"], quotas, "p", "m", 333.0)[1].collect()
    assert all(abs(r.off) < 1 for r in rep) and abs(sum(r.off for r in rep)) < 1.01


def test_empty(spark):
    quotas = spark.createDataFrame(QUOTAS, "e string, b string, p double, m int")
    sample, report = B.quota_sample(make(spark).limit(0), ["e", "b"], quotas, "p", "m", 10.0)
    assert sample.collect() == [] and all(r.drawn == 0 for r in report.collect())
    assert B.quota_sample(make(spark), ["e", "b"], quotas.limit(0), "p", "m", 10.0)[0].collect() == []


def test_many_quotas(spark):
    records = spark.range(200_000).selectExpr("id", "cast(id % 400 as int) e", "cast(id % 251 as int) b")
    quotas = spark.range(400 * 251).selectExpr("cast(id % 400 as int) e", "cast(id div 400 as int) b", "0.000005D p", "0 m")
    assert quotas.count() > 100_000
    sample, report = B.quota_sample(records, ["e", "b"], quotas, "p", "m", 100_000.0)
    r = report.selectExpr("count(*)", "sum(drawn)", "max(abs(drawn - least(wanted, available)))").first()
    assert r[0] == 100_400 and r[2] < 1 and sample.count() == r[1] and abs(r[1] - 50_000) < 300
