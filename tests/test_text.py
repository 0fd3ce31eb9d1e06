import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cotejo.functions import text as T


@given(st.text(max_size=40))
def test_cleaning_again_changes_nothing(s):
    assert T.clean_cell(T.clean_cell(s)) == T.clean_cell(s)


@pytest.mark.parametrize(("a", "b"), [("  a   b\n", "a b"), ("ﬁn­", "fin"), ("m²", "m²"), ("é", "é"), ("Ａ", "Ａ"), ("a​b", "ab"), ("", "")])
def test_clean(a, b):
    assert T.clean_cell(a) == b


def test_coherence():
    assert T.coherence("uno dos tres", "uno dos tres") == 1.0 and T.coherence("", "x") == 0.0
    assert T.coherence("Pág. 4\nuno dos", "uno dos", ["Pág. "]) == 1.0 and T.coherence("Pág. 4\nuno dos", "uno dos") < 1
    long = " ".join(f"w{i}" for i in range(12_500))
    assert T.coherence(long + " z", long + " y") < 1 and T.coherence(long + " z", long + " y", most=12_000) == 1.0


def test_columns(spark):
    df = spark.createDataFrame([("a%b/c", "²", "áb€😀", 1234.5), (None, "12", "", None)], "k string, n string, s string, x double")
    r = df.select(T.doc_key(F.lit("e/"), F.col("k")), T.html_int(F.col("n")), T.code_points(F.col("s")), T.local_number(F.col("x"), 2)).collect()
    assert tuple(r[0]) == ("e%2F/a%25b%2Fc", 1, "U+00E1 U+0062 U+20AC U+1F600", "1.234,50")
    assert tuple(r[1]) == (None, 12, "", "n/a")
    assert spark.range(1).select(T.short_date(F.lit("2031-03-09").cast("date"))).first()[0] == "9 mar 2031"
