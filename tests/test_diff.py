from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cotejo.operators.diff import diff, latest, residue

S = "k string, t int, a int, b int, field string"


def frame(spark, rows):
    return spark.createDataFrame(rows, S)


def out(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fields_and_sides(spark):
    left = frame(spark, [("x", 1, 1, None, "z"), ("y", 1, 2, 2, "z"), (None, 1, 5, 5, None), ("w", 1, 1, 1, "")])
    right = frame(spark, [("x", 1, 1, 3, "other"), ("v", 1, 2, 2, "z"), (None, 1, 5, 6, None), ("w", 1, 1, 1, None)])
    for unique in (True, False):
        got = out(diff(left, right, ["k", "t"], ["a", "b"], unique))
        assert got == sorted([("x", 1, "b", None, "3", 1, 1), ("y", 1, "only_left", None, None, 1, 0), ("v", 1, "only_right", None, None, 0, 1), (None, 1, "b", "5", "6", 1, 1)], key=str)


def test_repeated_keys_and_copies(spark):
    left = frame(spark, [("x", 1, 1, 1, ""), ("x", 1, 1, 1, ""), ("y", 1, 1, 1, ""), ("y", 1, 2, 2, "")])
    right = frame(spark, [("x", 1, 1, 1, ""), ("y", 1, 3, 3, "")])
    got = out(diff(left, right, ["k", "t"], ["a", "b"]))
    assert got == [("x", 1, "only_left", None, None, 1, 0), ("y", 1, "repeated_key", None, None, 2, 1)]


def test_empty(spark):
    none = frame(spark, [])
    one = frame(spark, [("x", 1, 1, 1, "")])
    assert out(diff(none, none, ["k", "t"], ["a", "b"])) == []
    assert out(diff(none, one, ["k", "t"], ["a", "b"]))[0][2] == "only_right"


def test_latest_ties_and_nulls(spark):
    rows = [("x", None, 9, 9, ""), ("x", 1, 1, 1, ""), ("x", 2, 1, None, ""), ("x", 2, 1, 4, ""), ("y", None, None, None, ""), (None, 1, 7, 7, ""), (None, 0, 8, 8, "")]
    assert out(latest(frame(spark, rows), ["k"], "t", ["a", "b"])) == sorted([("x", 1, 4), ("y", None, None), (None, 7, 7)], key=str)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 2)), max_size=12), st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 2)), max_size=12))
def test_residue_is_except_all_both_ways(spark, xs, ys):
    a, b = spark.createDataFrame(xs, "k string, v int"), spark.createDataFrame(ys, "k string, v int")
    want = {k: n for k, n in ((k, Counter(xs)[k] - Counter(ys)[k]) for k in {*xs, *ys}) if n}
    assert {(r.k, r.v): r["_n"] for r in residue(a, b, ["k", "v"]).collect()} == want
