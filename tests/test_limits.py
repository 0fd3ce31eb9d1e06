"""Just past the limits that operators once had."""

import pytest
from pyspark.sql import functions as F

from cotejo.functions import teds
from cotejo.operators import extraction, grid, sampling
from cotejo.plans.report import markdown


class _Wrapper(Exception):
    pass


def test_cause_among_arguments():
    kind = type("PDFSyntaxError", (Exception,), {})
    assert extraction.cause_of(_Wrapper(kind("torn"))) == "corrupt_pdf"
    assert extraction.cause_of(_Wrapper(_Wrapper(MemoryError()))) == "out_of_memory"
    assert extraction.cause_of(type("PSEOF", (Exception,), {})()) == "corrupt_pdf"
    assert extraction.cause_of(_Wrapper("nothing behind")) == "provider_error"


def test_cause_takes_the_nearest_and_ends():
    outer = _Wrapper(TimeoutError())
    outer.__cause__ = _Wrapper(MemoryError())
    assert extraction.cause_of(outer) == "timeout"
    a, b = _Wrapper(), _Wrapper()
    a.__cause__, b.__cause__ = b, a
    assert extraction.cause_of(a) == "provider_error"
    deep = MemoryError()
    for _ in range(6):
        deep = _Wrapper(deep)
    assert extraction.cause_of(deep) == "provider_error"


def test_long_texts_in_tree_costs():
    xs = [("a" * 33_000)[:-1] + c for c in "abcdefgh"]
    ys = ["b" + c for c in "abcdefgh"]
    got = teds.text_costs(xs, ys)
    assert got.shape == (8, 8) and abs(got[0, 0] - 1 + 1 / 33_000) < 1e-9


def test_markdown_keeps_every_row(spark):
    assert len(markdown(spark.range(1500)).splitlines()) == 1502


def test_a_cell_far_out_makes_a_large_table(spark):
    keys = ["t"]
    cells = spark.createDataFrame([(1, 0, 0, 0, 1, 1), (1, 1, 2**31 - 1, 2**31 - 1, 1, 1)], "t int, cell_idx int, row int, col int, rowspan int, colspan int")
    tables = spark.createDataFrame([(1, 2**31, 2**31, 1, 1, True, "html")], "t int, n_rows bigint, n_cols bigint, first_page int, last_page int, expresses_spans boolean, source_format string")
    assert [r["code"] for r in grid.findings(tables, cells, keys).collect()] == ["AREA_EXCESIVA"]
    assert grid.positions(cells, tables, keys).count() == 0 and grid.holes(grid.positions(cells, tables, keys), tables, keys).count() == 0


def test_other_dimensions(spark):
    a = spark.createDataFrame([(1, 2, 3), (2, 2, 3), (3, None, 3)], "t int, n_rows int, n_cols int")
    b = spark.createDataFrame([(1, 2, 3), (2, 3, 3), (3, 2, 3), (4, 1, 1)], "t int, n_rows int, n_cols int")
    assert sorted((r["t"], r["kind"]) for r in grid.compare_sizes(a, b, ["t"]).collect()) == [(2, "DIMENSION"), (3, "DIMENSION")]


@pytest.mark.parametrize("n", [3, 1000, 1001, 4000])
def test_top_n_of_any_n(spark, n):
    df = spark.range(5000).select(F.when(F.col("id") % 5 > 0, F.lit("a")).alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
    got = sampling.top_n(df, ["k"], ["v"], n)
    rows = [(r.k, r.v) for r in df.collect()]
    for k in ("a", None):
        want = sorted(v for q, v in rows if q == k)[:n]
        mine = sorted((r.place, r.v) for r in got.filter(F.col("k").eqNullSafe(F.lit(k))).collect())
        assert mine == list(enumerate(want, 1))


@pytest.mark.parametrize("n", [0, 1, 999, 1001, 3999, 9000])
def test_first_drawn_orders_one_bucket_only(spark, n):
    df = spark.range(5000).select("id", F.when(F.col("id") % 5 > 0, F.lit("a")).alias("k"), F.xxhash64("id").alias("d"))
    sized = df.withColumn("n", F.lit(n)).withColumn("size", F.when(F.col("k").isNull(), 1000).otherwise(4000))
    got = sampling.first_drawn(sized, ["k"], "d", "n", "size", ["id"], together=50)
    rows = [(r.k, r.d, r.id) for r in df.collect()]
    for k in ("a", None):
        want = sorted((d, i) for q, d, i in rows if q == k)[:n]
        assert sorted((r.d, r.id) for r in got.filter(F.col("k").eqNullSafe(F.lit(k))).collect()) == want


def test_bootstrap_repeats_no_row(spark):
    from cotejo.operators import stats

    t = stats.poisson_times(spark.range(2000).select(F.xxhash64("id")).toPandas().iloc[:, 0].to_numpy().view("uint64"), 50)
    assert abs(t.mean() - 1) < 0.02 and abs(t.var() - 1) < 0.05
    assert (t == stats.poisson_times(spark.range(2000).select(F.xxhash64("id")).toPandas().iloc[:, 0].to_numpy().view("uint64"), 50)).all()


def test_cut_tables_go(spark):
    from cotejo import sources

    with sources.scratch(spark):
        kept = sources.cut(spark.range(5).withColumn("b", F.col("id") % 2), "try", by=["b"])
        path = kept.inputFiles()[0]
        assert sorted((r.id, r.b) for r in kept.collect()) == [(i, i % 2) for i in range(5)] and kept.columns == ["id", "b"]
    import os

    assert not os.path.exists(path.removeprefix("file://"))
