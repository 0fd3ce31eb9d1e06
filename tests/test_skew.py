import pytest

from cotejo.operators.skew import heavy_keys, heavy_keys_of, salted_aggregate, salted_distinct, salted_join, shares_at_least


def frame(spark, keys):
    return spark.createDataFrame([(k, i, None if i % 7 == 0 else i) for i, k in enumerate(keys)], "k string, i int, v int").repartition(3)


KEYS = ["hot"] * 400 + [None] * 50 + [f"k{i % 90}" for i in range(550)]
AGGS = [("n", "count", None), ("nv", "count", "v"), ("s", "sum", "v"), ("lo", "min", "v"), ("hi", "max", "v")]


def plain(df):
    from pyspark.sql import functions as F

    return {tuple(r) for r in df.groupBy("k").agg(F.count(F.lit(1)), F.count("v"), F.sum("v"), F.min("v"), F.max("v")).collect()}


def test_salted_equals_plain(spark):
    df = frame(spark, KEYS)
    for heavy in (None, heavy_keys(df, "k", 0.2)):
        assert {tuple(r) for r in salted_aggregate(df, ["k"], AGGS, heavy, 8).collect()} == plain(df)


def test_heavy_is_a_superset(spark):
    h = heavy_keys(frame(spark, KEYS), "k", 0.2)
    assert h.rows == 1000 and "hot" in h.keys and None not in h.keys


def test_shares_count_null_rows_and_ties(spark):
    df = frame(spark, ["a"] * 4 + ["b"] * 4 + [None] * 92)
    assert {tuple(r) for r in shares_at_least(df, ["k"], 0.04).collect()} == {("k", "a", 4), ("k", "b", 4)}
    assert shares_at_least(df, ["k"], 0.05).collect() == []
    both = df.withColumn("w", (df["i"] % 2).cast("int"))
    assert {tuple(r) for r in shares_at_least(both, ["k", "w"], 0.04).collect()} == {("k", "a", 4), ("k", "b", 4), ("w", "0", 50), ("w", "1", 50)}


def test_empty_and_bad_arguments(spark):
    df = frame(spark, [])
    assert heavy_keys(df, "k", 0.1).keys == () and shares_at_least(df, ["k"], 0.1).collect() == []
    assert salted_aggregate(df, ["k"], AGGS).collect() == []
    with pytest.raises(ValueError):
        salted_aggregate(df, ["k"], [("x", "avg", "v")])
    with pytest.raises(ValueError):
        heavy_keys(df, "k", 0.0)


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 3, 4)], "_salt string, n int, _k0 int")
    assert [tuple(r) for r in salted_aggregate(df, ["_salt"], [("n", "count", None), ("s", "sum", "n")]).collect()] == [("a", 2, 4)]


def test_distinct_equals_plain(spark):
    from pyspark.sql import functions as F

    df = frame(spark, KEYS).withColumn("w", F.col("i") % 13)
    want = {tuple(r) for r in df.groupBy("k").agg(F.count_distinct("v"), F.count_distinct("w")).collect()}
    assert {tuple(r) for r in salted_distinct(df, ["k"], ["v", "w"], 8).collect()} == want
    assert [tuple(r) for r in salted_distinct(df.filter("v IS NULL"), ["k"], ["v"]).filter("k = 'hot'").collect()] == [("hot", 0)]
    assert salted_distinct(df.limit(0), ["k"], ["v"]).collect() == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_equals_plain(spark, how):
    big = frame(spark, KEYS).withColumnRenamed("v", "_salt")
    small = spark.createDataFrame([("hot", 1, "x"), ("hot", 2, "y"), ("k3", 3, "z"), (None, 4, "n"), ("other", 5, "o")], "k string, i int, _part string")
    want = sorted(map(str, big.alias("a").join(small.alias("b"), "k", how).select("a.k", "a.i", "a._salt", "b.i", "b._part").collect()))
    for heavy in heavy_keys_of(big, ["k", "i"], 0.2)[0], heavy_keys(big.limit(0), "k", 0.2):
        got = salted_join(big, small, "k", heavy, 8, how)
        assert got.columns == ["k", "i", "_salt", "i", "_part"] and sorted(map(str, got.collect())) == want
    assert salted_join(big.limit(0), small, "k", heavy, 8, how).collect() == []
