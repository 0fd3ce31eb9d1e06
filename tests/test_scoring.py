from collections import Counter

import pytest
from pyspark.sql import functions as F

from cotejo.operators import scoring as S

CELL = "row int, col int, rowspan int, colspan int, text string"


def gold(spark):
    t = [(1, 0, False), (1, 1, True), (2, 0, False), (3, 0, False)]
    c = [(d, i, 0, 0, 1, 2 if s else 1, f"x{d}{i}") for d, i, s in t] + [(1, 0, 0, 1, 1, 1, "y"), (1, 0, 0, 1, 1, 1, "y")]
    return spark.createDataFrame(t, "doc int, table_idx int, has_span boolean"), spark.createDataFrame(c, f"doc int, table_idx int, {CELL}")


def pred(spark):
    t = [("a", 1, 0, True), ("a", 1, 1, True), ("a", 2, 0, True), ("b", 1, 0, False), ("b", 1, 1, False), ("b", 2, 0, False), ("b", 2, 1, False), ("b", 9, 0, False)]
    c = [("a", 1, 0, 0, 0, 1, 1, "x10"), ("a", 1, 0, 0, 1, 1, 1, "y"), ("a", 1, 1, 0, 0, 1, 2, "x11"), ("a", 2, 0, 0, 0, 1, 1, "other"), ("b", 1, 0, 0, 0, 1, 1, "x10"), ("b", 1, 1, 0, 0, 1, 1, "x11")]
    return spark.createDataFrame(t, "extractor string, doc int, table_idx int, expresses_spans boolean"), spark.createDataFrame(c, f"extractor string, doc int, table_idx int, {CELL}")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_counts_and_detection(spark):
    c = S.counts(gold(spark)[0], pred(spark)[0], ["a", "b"])
    assert rows(c, "extractor", "doc", "n_gold", "n_pred", "same") == [("a", 1, 2, 2, True), ("a", 2, 1, 1, True), ("a", 3, 1, 0, False), ("b", 1, 2, 2, True), ("b", 2, 1, 2, False), ("b", 3, 1, 0, False)]
    assert rows(S.detection(c), "extractor", "documents", "equal", "extra", "missing", "true_tables") == [("a", 3, 2, 0, 1, 4), ("b", 3, 1, 1, 1, 4)]


def test_cell_scores(spark):
    same = S.counts(gold(spark)[0], pred(spark)[0], ["a", "b"]).filter("same")
    s = S.cell_scores(gold(spark)[1], pred(spark)[1], same, ["a", "b"])
    got = {(r.extractor, r.doc, r.table_idx): (r.hits, r.n_pred, r.n_gold, r.f1, r.accuracy) for r in s.collect()}
    assert got[("a", 1, 0)] == (2, 2, 3, pytest.approx(0.8), pytest.approx(2 / 3))  # the second y is matched once
    assert got[("a", 2, 0)] == (0, 1, 1, 0.0, 0.0) and got[("b", 1, 1)][0] == 0 and len(got) == 5
    assert rows(S.by_document(s, "f1").withColumn("score", F.round("score", 3)), "extractor", "doc", "score") == [("a", 1, 0.9), ("a", 2, 0.0), ("b", 1, 0.25)]


def test_evaluable_report_and_null(spark):
    g, p = gold(spark), pred(spark)
    c = S.counts(g[0], p[0], ["a", "b", "c"])
    pairs = S.evaluable_pairs(g[0], p[0], c.filter("same"))
    assert rows(pairs.filter("NOT evaluable"), "extractor", "doc", "table_idx") == [("b", 1, 1)]
    truth = c.groupBy("extractor").agg(F.sum("n_gold").alias("true_tables"))
    got = {r.extractor: r for r in S.report(S.cell_scores(g[1], p[1], c.filter("same"), ["a", "b", "c"]), pairs, truth, "f1").collect()}
    assert got["a"].coverage == 0.75 and got["b"].coverage == 0.25
    assert got["c"].score is None and got["c"].documents == 0 and got["c"].coverage == 0


def test_two_intersections(spark):
    d = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.7), ("a", 2, 1.0)], "extractor string, doc int, score double")
    h = {r.extractor: r for r in S.head_to_head(d, 2).collect()}
    assert (h["a"].common, h["a"].own, h["a"].delta, h["a"].documents) == (0.5, 0.75, -0.25, 1) and h["b"].delta == 0
    assert S.head_to_head(d.filter("doc = 2"), 2).collect() == []
    c = spark.createDataFrame([("a", 1, True), ("b", 1, True), ("a", 2, True), ("b", 2, False), ("a", 3, True), ("b", 3, True)], "extractor string, doc int, same boolean")
    pages = spark.createDataFrame([(1, 1), (2, 60)], "doc int, n_pages int")
    assert rows(S.agreement_by_band(c, pages, 2), "band", "agree", "population") == [("(sin páginas)", 1, 1), (">50", 0, 1), ("una página", 1, 1)]
    w = S.page_weighted(d, spark.createDataFrame([(1, 3), (2, 1)], "doc int, n_pages int")).collect()
    assert {r.extractor: r.score for r in w} == {"a": 0.625, "b": 0.7}
    assert S.page_weighted(d, spark.createDataFrame([(1, 0)], "doc int, n_pages int")).first().score is None


def test_bands_raise_where_asked(spark):
    df = spark.createDataFrame([(1,), (10,), (51,), (None,), (0,)], "p int")
    assert Counter(r[0] for r in df.select(S.band(F.col("p"), S.REPORT_BANDS)).collect()) == {"una página": 1, "2-10": 1, ">50": 1, "(sin páginas)": 2}
    with pytest.raises(Exception, match="no band"):
        df.select(S.band(F.col("p"), S.COST_BANDS, None)).collect()


def test_publishable(spark):
    df = spark.createDataFrame([(-0.2,), (0.4,), (None,)], "x double")
    assert [r[0] for r in df.select(S.publishable(F.col("x"))).collect()] == [0.0, 0.4, None]


def test_teds_of_equal_and_other(spark):
    t = spark.createDataFrame([("a", 1, 0, 1), ("a", 2, 0, 0)], "extractor string, doc int, table_idx int, n_rows int")
    c = spark.createDataFrame([("a", 1, 0, 0, 0, 0, 1, 1, "x", False)], f"extractor string, doc int, table_idx int, cell_idx int, {CELL}, is_header boolean")
    p = S.as_tables(c, t, S.TABLE)
    g = S.as_tables(c.withColumn("text", F.lit("y")).drop("extractor"), t.drop("extractor"), ["doc", "table_idx"])
    pairs = t.select(*S.TABLE, F.lit(True).alias("evaluable"))
    assert {r.doc: (round(r.teds, 6), r.teds_s) for r in S.teds_scores(g, p, pairs).collect()} == {1: (0.666667, 1.0), 2: (1.0, 1.0)}
