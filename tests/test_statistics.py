import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cotejo.operators import order_stats as O
from cotejo.operators import running as R
from cotejo.operators import sampling as P
from cotejo.operators import stats as S


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=40))
def test_order_statistics(spark, xs):
    df = spark.createDataFrame([("g", x) for x in xs] + [(None, xs[0]), ("g", None), ("n", None)], "k string, x double")
    got = {r.k: r for r in O.nth(df, ["k"], "x", {"lo": O.LOWER_MEDIAN, "up": O.UPPER_MEDIAN, "p90": O.P90, "sixth": lambda n: F.lit(6)}).collect()}
    s, n = sorted(xs), len(xs)
    assert set(got) == {"g", None} and got["g"].n == n
    assert (got["g"].lo + got["g"].up) / 2 == pytest.approx(statistics.median(xs)) and got["g"].p90 == s[min(n - 1, n * 9 // 10)]
    assert got["g"].sixth == (s[5] if n > 5 else None)
    q = {r.k: r for r in O.quartiles(df, ["k"], "x").collect()}
    if n > 1:
        assert [q["g"].q1, q["g"].q2, q["g"].q3] == pytest.approx(statistics.quantiles(xs, n=4, method="exclusive"), rel=1e-9, abs=1e-6)
    assert q[None].q1 is None


def test_wilson(spark):
    df = spark.createDataFrame([(3, 338), (0, 0), (5, 5)], "h int, n int")
    lo, hi = S.wilson(F.col("h"), F.col("n"))
    got = df.select(lo, hi).collect()
    p, n = 3 / 338, 338
    d = 1 + 1.96**2 / n
    mid, half = (p + 1.96**2 / (2 * n)) / d, 1.96 * math.sqrt(p * (1 - p) / n + 1.96**2 / (4 * n * n)) / d
    assert tuple(got[0]) == pytest.approx((mid - half, mid + half)) and tuple(got[1]) == (0, 0) and got[2][1] == 1.0


def test_slope_ratio_error(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.0), ("b", 1.0, 1.0), ("c", 1.0, 5.0), ("c", 2.0, 5.0), ("c", 9.0, 5.0), ("z", 1.0, 0.0)], "k string, y double, x double")
    assert {r.k: r.slope for r in S.slope(df, ["k"], "y", "x").collect()} == {"a": 0.5, "b": None, "c": 0.0, "z": None}
    assert {r.k: r.ratio for r in S.ratios(df, ["k"], "y", "x").collect()}["z"] is None
    e = spark.range(1).select(*S.estimator_error(F.lit(3.0), F.lit(2.0))).first()
    assert tuple(e) == pytest.approx((0.5, -1 / 3))


def test_bootstrap_covers(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("s", str(i), 2.0 * (p := rng.randint(1, 9)) + rng.gauss(0, 1), float(p)) for i in range(300)], "s string, u string, c double, p double")
    w = spark.createDataFrame([("s", 100.0)], "s string, w double")
    r = S.bootstrap_ratio(df, "s", "u", "c", "p", w, "w", replicas=200).first()
    assert r.low < r.total < r.high and abs(r.total - 200) < 10 and r.high - r.low < 20


def test_running(spark):
    rows = [(i, i // 10, i % 3 == 0) for i in range(57)]
    df = spark.createDataFrame(rows, "i int, b int, x boolean").repartition(4)
    t = R.running_totals(df, ["i"], {"n": F.lit(1), "s": F.col("x").cast("int")})
    assert [(r.n, r.s) for r in t.orderBy("i").collect()] == [(i + 1, i // 3 + 1) for i in range(57)]
    assert R.stop_point(t, "n", "n", "s", 20, 0.05).first().i == 19
    assert R.until_target(t, "s", F.col("x").cast("int"), 2).count() == 4
    assert R.running_totals(df.limit(0), ["i"], {"n": F.lit(1)}).collect() == []


def test_gaps(spark):
    df = spark.sql("SELECT id, timestamp_seconds(id * id) AS t FROM range(1, 9)").repartition(3)
    g = R.gaps(df, "t", ["t"]).orderBy("id").collect()
    assert [r.gap for r in g] == [None, *[2.0 * i + 1 for i in range(1, 8)]]


def test_quota_and_samples(spark):
    s = spark.createDataFrame([("2-10", 50, 0), ("11-50", 30, 1), (">50", 20, 2)], "b string, n int, o int")
    assert {r.b: r.quota for r in P.largest_remainder(s, F.col("o"), "n", 17).collect()} == {"2-10": 9, "11-50": 5, ">50": 3}
    df = spark.createDataFrame([(f"k{i}", "a" if i < 50 else "b") for i in range(53)], "k string, s string")
    got = P.stratified(df, "s", "k", 10, "1").collect()
    assert sum(r.s == "a" for r in got) == 10 and sum(r.s == "b" for r in got) == 3


def test_pending_and_frontier(spark):
    u = spark.createDataFrame([("d1",), ("d2",), ("d2",)], "id string")
    done = spark.createDataFrame([("a", "d1"), ("a", "d1")], "extractor string, id string")
    assert sorted(tuple(r) for r in P.pending(u, done, ["a", "b"], "id").collect()) == [("a", "d2"), ("b", "d1"), ("b", "d2")]
    f = spark.createDataFrame([(str(i), i, i % 2 == 0) for i in range(6)], "id string, w int, ok boolean")
    assert {r.k: (r.n, r.s) for r in P.frontier(f, "ok", "id", "w", {"s": F.sum("w")}, 4).collect()} == {1: (4, 0 + 1 + 3 + 5), 2: (4, 0 + 2 + 1 + 3), 3: (4, 0 + 2 + 4 + 1)}


def test_greedy(spark):
    rows = [("a", 5, "x", True, False), ("b", 1, "x", False, False), ("c", 2, "x", False, None), ("d", 9, "y", False, True), ("e", 3, "y", True, False), ("f", 3, "q", True, True)]
    df = spark.createDataFrame(rows, "id string, w int, band string, p boolean, q boolean")
    got = [tuple(r) for r in P.greedy(df, "id", "w", "band", [("x", 2), ("y", 3)], ["p", "q"]).orderBy("place").collect()]
    assert got == [("a", "x", "fenómeno · p", 1), ("b", "x", "reparto · banda x", 2), ("d", "y", "fenómeno · q", 3), ("e", "y", "reparto · banda y", 4)]
    assert P.greedy(df.limit(0), "id", "w", "band", [("x", 2)], ["p"]).collect() == []


def test_numbered_goes_through_a_group_in_ranges(spark):
    rows = [(None if i % 5 == 0 else "a", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(7)
    got = R.numbered(df, ["k"], ["i"], "n").collect()
    for k in (None, "a"):
        mine = sorted((r.i, r.n) for r in got if r.k == k)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    assert R.numbered(df.limit(0), ["k"], ["i"], "n").collect() == []
