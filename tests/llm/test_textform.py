import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cotejo.llm import textform as T

SAME = [
    ("Ａｙｕｎ 12", "Ayun 12"), ("río", "río"), ("a b", "a b"), ("su­fi​cien‍te", "suficiente"), ("Сasа", "Casa"),
    ("ΑΒ", "AB"), ("օro", "oro"), ("ﬁn", "fin"), ("Ⅱ", "II"), ("A‑B", "A-B"), ("…", "..."), ("о́", "ó"), (" x ", "x"),
]
DIFFERENT = [("A", "a"), ("1ª", "1a"), ("Nº", "No"), ("m²", "m2"), ("é", "e"), ("té", "te"), ("3", "8"), ("½", "1/2"), ("x", "x *")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_looks(a, b):
    assert T.looks(a) == T.looks(b) and T.canonical(a) == T.canonical(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_looks(a, b):
    assert T.looks(a) != T.looks(b)


@settings(max_examples=400)
@given(st.text(max_size=30))
def test_forms_are_stable(t):
    assert T.looks(T.looks(t)) == T.looks(t)
    assert T.canonical(T.canonical(t)) == T.canonical(t)
    assert T.canonical(T.looks(t)) == T.canonical(t)


@settings(max_examples=300)
@given(st.text(max_size=30), st.text(max_size=30))
def test_form_and_marks_say_what_looks_says(a, b):
    for x, y in ((a, b), (a, a.swapcase()), (a, T.looks(a))):
        assert (T.form_and_marks(x) == T.form_and_marks(y)) == (T.looks(x) == T.looks(y))


def test_loaded_table(spark):
    table = T.confusables(spark)
    for a, b in [("ν", "v"), ("ρ", "p"), ("Ӏ", "I"), ("ɡ", "g"), ("Ꭺ", "A"), ("ꓐ", "B"), ("ⲟ", "o"), ("Г", "Γ"), *SAME]:
        assert T.looks(a, table) == T.looks(b, table), (a, b)
        assert T.canonical(T.canonical(a, table), table) == T.canonical(a, table)
    for a, b in [("l", "1"), ("I", "l"), ("O", "0"), ("m", "rn"), *DIFFERENT]:
        assert T.looks(a, table) != T.looks(b, table) and T.form_and_marks(a, table) != T.form_and_marks(b, table), (a, b)
    for o in table:
        assert T.canonical(T.canonical(chr(o), table), table) == T.canonical(chr(o), table)


def test_columns(spark):
    rows = [("a", "a", "61"), ("a", "а", None), ("A", "a", None), ("fin", "ﬁn", "0x66 69 6E"), (None, "a", "\\x61"), (None, "a", None), ("a", "b", "zz"), ("x", "x", "ff"), ("a" * 50000, "a" * 50000 + "​", None)]
    df = spark.createDataFrame(rows, "p string, q string, h string")
    df = df.withColumn("i", F.monotonically_increasing_id()).withColumn("t", T.from_hex(F.col("h"))).cache()
    for table in (T._TABLE, T.confusables(spark)):
        got = {r.i for r in T.look_alike(df, ["p", "q", "t"], table).collect()}
        assert [r.t for r in df.collect()] == ["a", None, None, "fin", "a", None, "", None, None]
        assert [r.i in got for r in df.collect()] == [False, True, False, True, False, False, False, False, True]
    assert df.limit(0).select(T.canonical_form()("p")).collect() == [] and T.look_alike(df.limit(0), ["p", "q"]).collect() == []


def test_word_set(spark):
    df = spark.createDataFrame([("Índice_plegada · 12 índice",), ("PLEGADA indice",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.word_set("t")).collect()] == ["indice plegada", "indice plegada", None, ""]
