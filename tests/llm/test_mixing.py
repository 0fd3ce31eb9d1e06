import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cotejo.llm import mixing as M


def test_tokens():
    assert M.count_tokens(None) == M.count_tokens("") == 0
    encode = M._encoder(M.VOCABULARY).encode_ordinary
    for text in ("la casa verde " * 9000, "a" * 300_000, "ab1-" * 60_000, "una línea\n" * 20_000, "\n" * 150_000):
        assert M.count_tokens(text) == len(encode(text)) > 0


def test_tempered():
    own = np.array([100.0, 10.0, 0.0])
    assert M.tempered(own, 1)[0] == pytest.approx(100 / 110) and M.tempered(own, 0)[0] == pytest.approx(0.5)
    assert M.tempered(own, 0, [0.2, 0.6, 0.2])[1] == pytest.approx(0.75) and M.tempered(own, 1, [0.2, 0.6, 0.2])[1] == pytest.approx(10 / 110)
    e = M.exponent_for_entropy(own, 0.6)
    assert M.entropy(M.tempered(own, e)) == pytest.approx(0.6, abs=1e-6)
    r = M.exponent_for_repeats(own, 110.0, [2, 3, 9])
    assert M.tempered(own, r)[1] * 110 == pytest.approx(30, abs=1e-6)
    assert len(M.tempered([], 0.5)) == 0 and M.tempered(own, 0.3).sum() == pytest.approx(1) and not M.tempered([0.0, 0.0], 0.5).any()


ROWS = st.lists(st.tuples(st.integers(0, 1000), st.floats(0, 1), st.integers(0, 9)), min_size=1, max_size=8)


def columns(rows):
    own, target, repeats = (np.array(c, dtype=float) for c in zip(*rows, strict=True))
    return own, target / (target.sum() or 1.0), repeats


@given(ROWS)
def test_budgets(rows):
    own, target, repeats = columns(rows)
    size = own.sum()
    b = M.budgets(own, target, repeats, size)
    assert (b >= -1e-6).all() and (b <= own * repeats + 1e-6).all()
    assert b.sum() == pytest.approx(min(target.sum() * size, (own * repeats).sum()), rel=1e-6, abs=1e-3)
    met = repeats * own >= target * size
    assert (b[met] >= target[met] * size * (1 - 1e-9) - 1e-6).all() and np.allclose(b[~met], (own * repeats)[~met])


@given(ROWS)
def test_own_exponents(rows):
    own, target, repeats = columns(rows)
    size = own.sum()
    e = M.own_exponents(own, target, repeats, size)
    assert ((e > 0) == (repeats * own < target * size)).all()
    for k in np.flatnonzero((e > 1e-6) & (e < 1)):  # where the source's tempered share just fits
        assert M.tempered(own, e[k], target)[k] * size == pytest.approx(repeats[k] * own[k], rel=0.02)


def test_plan_of_many_sources(spark):
    sized = spark.range(120_000).selectExpr("concat('s', id) source", "1 + id % 7 tokens")
    targets = spark.range(120_000).selectExpr("concat('s', id) source", "1D / 120000D w", "1 r")
    plan = M.source_plan(sized, targets, "source", "tokens", "w", "r")
    total = sized.agg(F.sum("tokens")).first()[0]
    got = plan.agg(F.count(F.lit(1)), F.sum("budget"), F.count_if(F.col("budget") > F.col("tokens") + 1e-6), F.count_if("reachable")).first()
    assert got[0] == 120_000 and abs(got[1] - total) < 1 and got[2] == 0 and got[3] == sized.filter(f"tokens >= {total} / 120000D").count()


def test_mix(spark):
    docs = [(i, "big" if i % 3 else "small", "una frase de prueba " * (1 + i % 9)) for i in range(900)] + [(9000, None, "x y"), (9001, "big", None), (9002, "other", "fuera de lista"), (9003, "big", "")]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(3)
    t = spark.createDataFrame([("big", 0.2, 2), ("small", 0.75, 2), ("none", 0.05, 5)], "source string, w double, r int")
    sized = M.sized_documents(d, "doc_id", "source", "text")
    assert sized.count() == 901
    plan = M.source_plan(sized, t, "source", "tokens", "w", "r")
    by = {p["source"]: p for p in plan.collect()}
    assert by["big"]["reachable"] and not by["small"]["reachable"] and not by["none"]["reachable"]
    for together in (1, 30, 20_000):
        rows = M.mix(sized, plan, "doc_id", "source", "tokens", together=together).collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        for s in ("big", "small"):
            used = sum(r.tokens * r.copies for r in rows if r.source == s)
            assert by[s]["budget"] - 100 < used <= by[s]["budget"] + 1e-6
            assert max(r.copies for r in rows if r.source == s) <= 2
    assert {r.tokens for r in M.source_plan(sized.limit(0), t, "source", "tokens", "w", "r").collect()} == {0}
    assert M.source_plan(sized, t.limit(0), "source", "tokens", "w", "r").collect() == []
    assert M.mix(sized.limit(0), plan, "doc_id", "source", "tokens").collect() == []
