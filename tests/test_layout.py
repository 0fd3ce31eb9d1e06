import pandas as pd
import pytest

from cotejo.functions import layout as L


def cells(t):
    return [(c["row"], c["col"], c["rowspan"], c["colspan"], c["text"]) for c in t["cells"]]


def test_spans_push_cells():
    t = L.tables_from_html("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>")[0]
    assert cells(t) == [(0, 0, 2, 1, "a"), (0, 1, 1, 1, "b"), (1, 1, 1, 1, "c")] and (t["n_rows"], t["n_cols"]) == (2, 2)


def test_section_overflow_and_endless_rowspan():
    t = L.tables_from_html("<table><thead><tr><th rowspan=2>h</th></tr></thead><tbody><tr><td rowspan=0>a</td><td>b</td></tr><tr><td>c</td></tr></tbody><tr><td>d</td></tr></table>")[0]
    assert cells(t) == [(0, 0, 2, 1, "h"), (2, 0, 2, 1, "a"), (2, 1, 1, 1, "b"), (3, 1, 1, 1, "c"), (4, 0, 1, 1, "d")]
    assert t["cells"][0]["is_header"] and not t["cells"][1]["is_header"] and t["n_rows"] == 5


def test_overlap_is_kept_and_limits():
    t = L.tables_from_html("<table><tr><td>x</td><td rowspan=2>a</td></tr><tr><td colspan=2>b</td></tr><tr><td colspan=5000 rowspan=-3>c</td><td colspan='²'>d</td></tr></table>")[0]
    assert (1, 0, 1, 2, "b") in cells(t) and (2, 0, 1, 1000, "c") in cells(t) and (2, 1000, 1, 1, "d") in cells(t)


def test_nested_unclosed_caption_blocks():
    a, b = L.tables_from_html("<p>x</p><table><caption> Una </caption><tr><td><p>a</p><p>b</p><table><tr><td>in</td></table>c<b>d</b>")
    assert cells(a) == [(0, 0, 1, 1, "a b cd")] and a["caption"] == "Una" and cells(b) == [(0, 0, 1, 1, "in")]
    assert L.tables_from_html("<table></table>")[0]["n_rows"] == 0 and L.tables_from_html("") == []


def test_markdown():
    t = L.tables_from_markdown("x\n| **a** | [b](u) |\n|---|:-:|\n| c<br>d |\n| e_f | `g` | h |\nend")[0]
    assert cells(t) == [(0, 0, 1, 1, "a"), (0, 1, 1, 1, "b"), (1, 0, 1, 1, "c d"), (2, 0, 1, 1, "e_f"), (2, 1, 1, 1, "g"), (2, 2, 1, 1, "h")]
    assert t["n_cols"] == 3 and not t["expresses_spans"] and L.tables_from_markdown("a | b\nc | d") == []


def test_text_tei_frame():
    assert cells(L.tables_from_text("a  b\nc\td\n\nx  y\nz  w  v")[0]) == [(0, 0, 1, 1, "a"), (0, 1, 1, 1, "b"), (1, 0, 1, 1, "c"), (1, 1, 1, 1, "d")]
    tei = '<TEI xmlns="urn:x"><table><head>T</head><row role="label"><cell cols="2">a</cell></row><row><cell>b</cell><cell role="label">c</cell></row></table></TEI>'
    t = L.tables_from_tei(tei)[0]
    assert cells(t)[0] == (0, 0, 1, 2, "a") and t["caption"] == "T" and [c["is_header"] for c in t["cells"]] == [True, False, True]
    assert L.tables_from_tei(" ") == []
    with pytest.raises(ValueError):
        L.tables_from_tei("<!DOCTYPE x><a/>")
    f = L.table_from_frame(pd.DataFrame([["a", None], ["b", float("nan")]]))
    assert cells(f) == [(0, 0, 1, 1, "a"), (0, 1, 1, 1, ""), (1, 0, 1, 1, "b"), (1, 1, 1, 1, "")]
    assert cells(L.table_from_frame(pd.DataFrame({"h": ["x"]})))[0] == (0, 0, 1, 1, "h")
    with pytest.raises(TypeError):
        L.table_from_frame([[1]])


def test_columns(spark):
    df = spark.createDataFrame([(1, "<table></table><table><tr><td>a"), (2, ""), (3, None)], "id int, html string")
    t = L.tables_of(df, "html", "html", ["id"])
    assert [(r.id, r.table_idx, r.n_rows) for r in t.orderBy("table_idx").collect()] == [(1, 0, 0), (1, 1, 1)]
    assert [tuple(r)[:6] for r in L.cells_of(t, ["id", "table_idx"]).collect()] == [(1, 1, 0, 0, 0, 1)]
