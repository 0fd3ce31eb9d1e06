import json

import pytest
from pyspark.sql import functions as F

from cotejo.functions.layout import tables_from_html, to_html
from cotejo.operators import extraction as X
from cotejo.sources.profile import load_profile
from cotejo.sources.summaries import DailySummaries


class Odd:
    id, version, expresses_spans, runs_locally = "odd", "1", False, True

    def read(self, content):
        if content == b"slow":
            raise RuntimeError("x") from TimeoutError()
        if content == b"none":
            raise KeyError("x")
        return [{"cells": [{"row": 0, "col": 0, "rowspan": 2, "colspan": 1, "text": "a", "is_header": False}], "n_rows": 2, "n_cols": 1, "caption": None, "expresses_spans": False, "source_format": "text"}], 1


def test_extract_never_raises(spark):
    files = spark.createDataFrame([("1", b"<table><tr><td>a"), ("2", b"slow"), ("3", b"none"), ("4", b"\xff")], "doc string, content binary")
    plugins = {"odd": Odd(), "markup-html": X.Markup("html")}
    units = spark.createDataFrame([(e, d) for e in (*plugins, "unknown") for d in "12345"] + [("odd", "1")], "extractor string, doc string")
    got = {(r.extractor, r.doc): r for r in X.extract(units, files, plugins).collect()}
    assert len(got) == 15 and got[("markup-html", "1")].tables[0].cells[0].text == "a" and not got[("odd", "1")].failed
    assert [got[("odd", d)].failure_reason for d in "235"] == ["timeout", "provider_error", "provider_error"]
    assert got[("markup-html", "4")].failure_reason == "corrupt_pdf" and got[("unknown", "1")].failed
    found = {(r.extractor, r.check) for r in X.conformance(X.extract(units, files, plugins)).collect()}
    assert ("odd", "spans as declared") in found and not any(e == "markup-html" for e, _ in found)


def test_shape_and_registry():
    assert X.missing_members(Odd()) == [] and X.missing_members(object()) == list(X.MEMBERS) and isinstance(Odd(), X.Extractor)
    assert X.registered("no.such.group") == {}
    assert X.cause_of(MemoryError()) == "out_of_memory" and X.cause_of(ValueError()) == "provider_error"


def test_ranges_and_sets(spark):
    df = spark.createDataFrame([(1, 2), (0, 2), (3, 3)], "a int, b int")
    assert [r[0] for r in df.select(X.page_range_valid(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    a = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "doc string, kind string")
    b = spark.createDataFrame([("1", "x"), ("2", "y")], "doc string, kind string")
    assert sorted(tuple(r) for r in X.conformance_set(a, b).collect()) == [("2", "x", "y"), ("3", "y", None)]


def test_render_and_parse():
    t = tables_from_html("<table><thead><tr><th colspan=2>a &amp; b</th></tr></thead><tr><td rowspan=2>c</td><td>d</td></tr><tr><td>&lt;e&gt;</td></tr></table>")[0]
    assert tables_from_html(to_html(t))[0]["cells"] == t["cells"]


def test_summaries(spark, tmp_path):
    (tmp_path / "20310102.json").write_text(json.dumps({"dia": "2031-01-02", "x": [{"url_pdf": "https://ok.example/a"}]}))
    (tmp_path / "20310104.json").write_text(json.dumps({"dia": "2031-01-04", "url_xml": "https://bad.example/a"}))
    spark.dataSource.register(DailySummaries)
    read = spark.read.format("daily_summaries").option("path", str(tmp_path)).option("first", "2031-01-01").option("hosts", "ok.example")
    assert [str(r.dia) for r in read.option("last", "2031-01-03").option("seconds", "0.05").load().collect()] == ["2031-01-02"]
    with pytest.raises(Exception, match="allowed host"):
        read.option("last", "2031-01-05").load().collect()


def test_profile(tmp_path):
    good = "entity: bfi\nhosts: [a.example]\nsections: ['1']\nstrata: [x]\nboilerplate: ['Pág. ']\nseconds_between_requests: 1\ncoherence: 0.85\nthird_parties: false\n"
    p = tmp_path / "p.yaml"
    p.write_text(good)
    assert load_profile(str(p)).coherence == 0.85
    for bad in (good.replace("0.85", "2"), good + "more: 1\n", good.replace("[x]", "x"), good.replace("false", "0"), "x"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            load_profile(str(p))
