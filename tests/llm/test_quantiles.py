import math

import numpy as np

from cotejo.llm import quantiles as Q


def true(xs, p):
    xs = sorted(xs)
    return xs[max(1, math.ceil(p * len(xs) / 100 - 1e-9)) - 1]


def test_error_bound_and_merging(spark):
    rng = np.random.default_rng(1)
    xs = np.concatenate([rng.lognormal(0, 4, 2000), -rng.lognormal(2, 3, 700), np.zeros(50)]).tolist()
    junk = [None, float("nan"), float("inf"), -float("inf")]
    df = spark.createDataFrame([("g" if i % 3 else None, x, i % 5) for i, x in enumerate(xs + junk)], "k string, x double, day int")
    ps = [1, 25, 27, 50, 90, 99, 100]
    whole = {(r.k, r.percent): r.value for r in Q.percentiles(Q.sketch(df, ["k"], "x"), ["k"], ps).collect()}
    merged = Q.merge([Q.sketch(df.filter(f"day = {d}"), ["k"], "x") for d in range(5)], ["k"])
    assert {(r.k, r.percent): r.value for r in Q.percentiles(merged, ["k"], ps).collect()} == whole
    for k in ("g", None):
        own = [x for i, x in enumerate(xs) if ("g" if i % 3 else None) == k]
        for p in ps:
            assert abs(whole[(k, float(p))] - true(own, p)) <= 0.0100001 * abs(true(own, p))


def test_limit_inside_a_bucket_is_decided_exactly(spark):
    values = spark.createDataFrame([(k, float(x)) for k in ("a", "b", "c", "far", "low") for x in range(1000, 1011)] + [("a", None), ("a", float("nan"))], "k string, x double")
    limits = spark.createDataFrame([("a", 1004.0, 50), ("b", 1005.0, 50), ("c", 1005.5, 50), ("far", 900.0, 50), ("low", 2000.0, 50), ("none", 1.0, 50), ("a", None, 50), ("far", 900.0, 50)], "k string, lim double, p int")
    seen = Q.compared(Q.sketch(values, ["k"], "x"), ["k"], limits, ["k"], "lim", "p")
    assert {r.k: r.above for r in seen.collect()} == {"a": None, "b": None, "c": None, "far": True, "low": False}
    assert sorted(r.k for r in Q.above(values, ["k"], "x", limits, ["k"], "lim", "p").collect()) == ["a", "far"]


def test_null_subkey_is_a_group_in_both_passes(spark):
    values = spark.createDataFrame([("a", None, float(x)) for x in range(1000, 1011)] + [("a", "s", 1.0)], "k string, s string, x double")
    limits = spark.createDataFrame([("a", 1004.0, 50)], "k string, lim double, p int")
    assert [(r.k, r.s) for r in Q.above(values, ["k", "s"], "x", limits, ["k"], "lim", "p").collect()] == [("a", None)]


def test_empty(spark):
    df = spark.createDataFrame([], "k string, x double")
    limits = spark.createDataFrame([("a", 1.0, 50)], "k string, lim double, p int")
    assert Q.percentiles(Q.sketch(df, ["k"], "x"), ["k"], [50]).collect() == []
    assert Q.above(df, ["k"], "x", limits, ["k"], "lim", "p").collect() == []


def test_hot_group_and_ties(spark):
    df = spark.createDataFrame([("a", 7.0)] * 500 + [("b", -7.0)], "k string, x double")
    got = {r.k: r.value for r in Q.percentiles(Q.sketch(df, ["k"], "x"), ["k"], [50]).collect()}
    assert abs(got["a"] - 7) < 0.07 and abs(got["b"] + 7) < 0.07
