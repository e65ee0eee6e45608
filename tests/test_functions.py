"""Column functions on single values."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import similarity as S
from lectern.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize("text", ["Estadística básica", "ÇA  va — Übergröße", "İstanbul Kelvin", "ﬁn 한글", "a\tb", ""])
def test_norm_title_is_python_definition(spark, text):
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()
    expected = " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789 " else " " for c in bare).split())
    assert one(spark, T.norm_title, text) == expected


def test_dedupe_key_does_not_fold(spark):
    assert one(spark, T.dedupe_key, "Estadística!") == "estad stica"


@pytest.mark.parametrize(("text", "year"), [("2021-03-14", 2021), ("28 September 2010", 2010), ("", None), ("n.d.", None), ("12345", 1234), (None, None)])
def test_year_of(spark, text, year):
    assert one(spark, T.year_of, text) == year


@pytest.mark.parametrize("n", [1, 4, 9, 14, 40, 49, 90, 99, 154, 399, 1987])
def test_roman_round_trip(spark, n):
    numeral = one(spark, lambda c: T.roman_text(c.cast("int")), str(n))
    assert one(spark, T.roman_value, numeral) == n
    assert one(spark, T.roman_value, numeral.upper()) == n


@pytest.mark.parametrize("text", ["hello", "", None, "i" * 16])
def test_no_numeral(spark, text):
    assert one(spark, T.roman_value, text) == 0


def test_clean_abstract(spark):
    assert one(spark, T.clean_abstract, "<jats:p>Abstract: A &amp; B</jats:p>\n c") == "A & B c"
    # the label needs no boundary, and only four spellings are labels
    assert one(spark, T.clean_abstract, "AbstractThis is") == "This is"
    assert one(spark, T.clean_abstract, "aBSTRACT this") == "aBSTRACT this"
    assert one(spark, T.clean_abstract, "RESUMEN—&eacute;&#233;&#xe9;&nbsp; x &notanentity; &amplt") == "ééé x ¬anentity; &lt"


def test_html(spark):
    assert one(spark, T.text_to_html, "a\n\n b ") == "<p>a</p><p>b</p>"
    assert one(spark, T.text_to_html, "<b>x</b>") == "<b>x</b>"


def test_levenshtein_similarity(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", "a"), ("a", "a"), ("", "")], "a string, b string")
    assert [round(r.x, 4) for r in df.select(T.levenshtein_similarity(F.col("a"), F.col("b")).alias("x")).collect()] == [0.6667, 0.0, 1.0, 1.0]


def test_title_ratio_and_bound(spark):
    df = spark.createDataFrame([("network science", "networks of science"), ("", "a")], "a string, b string")
    rows = df.select(S.title_ratio(F.col("a"), F.col("b")).alias("r"), S.ratio_bound(F.col("a"), F.col("b")).alias("m")).collect()
    assert rows[0].r <= rows[0].m and rows[0].r > 0.8 and rows[1].r == 0.0


def test_sizes_and_versions(spark):
    assert one(spark, lambda c: T.human_size_binary(c.cast("long")), "1536") == "1.5 KB"
    assert one(spark, lambda c: T.human_size_decimal(c.cast("long")), "1500000") == "1.5 MB"
    assert one(spark, T.version_tuple, "1.10.3b") == [1, 10, 3]


@pytest.mark.parametrize(("text", "depth"), [("3.1.2. T", 3), ("1 Intro", 1), ("Intro", 0), ("2.4 X", 2), ("123 Apples", 0), ("1.2.3.4.5.6 x", 0), ("12.10.1.4 x", 4), ("3. ", 0)])
def test_numbering_depth(spark, text, depth):
    assert one(spark, T.numbering_depth, text) == depth


pair = st.tuples(st.text(alphabet="abc d", max_size=30), st.text(alphabet="abc d", max_size=30))
long_pair = st.tuples(st.text(alphabet="abcdefgh ijkl", min_size=150, max_size=260), st.text(alphabet="abcdefghijklmnopqrst uvwxyz", min_size=190, max_size=320))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(pair, long_pair, long_pair.map(lambda p: (p[0], p[0][:90] + p[1] + p[0][60:]))), min_size=1, max_size=8))
def test_gestalt_ratio_of_a_batch(pairs):
    from difflib import SequenceMatcher

    import pandas as pd

    from lectern.functions.similarity import _ratio

    got = _ratio.func(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert got.tolist() == [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]
