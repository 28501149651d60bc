import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from casefile.functions import numbers as N
from casefile.functions import textnorm as X


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o"))
    return [r["o"] for r in rows.orderBy("i").collect()]


def test_file_names(spark):
    urls = ["http://h/Apofasi-1614-2025.pdf", "Apofasi-A831-2025.pdf", "Apofasi-E11-2021.pdf", "Apofasi-AA55-2017.pdf", "Apofasi-Α873-2025.pdf", "apofasi_7-2020.PDF", "other.pdf", None]
    got = [tuple(x) for x in column(spark, urls, N.number_year_from_url)]
    assert got == [("1614", "2025"), ("A831", "2025"), ("E11", "2021"), ("AA55", "2017"), ("A873", "2025"), ("7", "2020"), ("", ""), ("", "")]


def test_numbers(spark):
    assert column(spark, ["A831", None, "12-3"], N.digits_of) == ["831", "", "123"]
    assert column(spark, [" αβ1 ", None, "Χ9"], N.normalize_number) == ["AB1", "", "X9"]
    assert column(spark, ["2025", "", None, "A831", " 12x", "-3"], N.leading_int) == [2025, 0, 0, 0, 12, -3]


def test_mirror(spark):
    got = column(spark, ["http://main/f/a.pdf", "http://old/x/b.pdf"], lambda c: N.candidate_urls(c, "main", "http://mirror/"))
    assert got == [["http://main/f/a.pdf"], ["http://old/x/b.pdf", "http://mirror/b.pdf"]]


def test_whitespace(spark):
    assert column(spark, ["  a  b\x1cc\n\td ", "", None], X.collapse_whitespace) == ["a b c d", "", None]


def test_norm_and_tokens(spark):
    texts = ["Άρθρο ΟΔΟΣ", "ΐ ΰ Ώ ñ é ß", "ab abc ab1 το abc"]

    def model(s):
        s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
        return s.lower().replace("ς", "σ")

    assert column(spark, texts, X.norm_text) == [model(t) for t in texts]
    want = [{t for t in re.split("[^0-9a-zα-ω]+", model(s)) if len(t) >= 3} for s in texts]
    assert [set(x) for x in column(spark, texts, X.search_tokens)] == want


def test_references(spark):
    texts = ["1617/2025", "απόφαση 1617 / 2025", "Α831/2025", "AA55/2017 και AA55/2017", "1617/1825", "Α831", "no 123456"]
    refs = [[tuple(r) for r in x] for x in column(spark, texts, X.decision_refs)]
    assert refs == [[("1617", "2025")], [("1617", "2025")], [("A831", "2025")], [("AA55", "2017")], [], [], []]
    assert column(spark, texts, X.query_numbers) == [["1617", "2025"], ["1617", "2025"], ["2025"], ["2017"], ["1617", "1825"], [], []]


@pytest.mark.parametrize("text, want", [("a" * 320, "a" * 320), ("b" * 300 + " " + "c" * 20, "b" * 300 + "…"), ("d" * 321, "d" * 320 + "…")])
def test_snippets(spark, text, want):
    assert column(spark, [text], X.snippet) == [want]


def test_title(spark):
    row = spark.createDataFrame([("1", "2020", "Τ"), (None, "2020", "")], "n string, y string, t string").select(X.decision_title(F.col("n"), F.col("y"), F.col("t")).alias("o")).collect()
    assert [r["o"] for r in row] == ["Απόφαση 1/2020 — Τ", "Απόφαση /2020"]


def test_strip_accents_is_the_decomposition_without_marks(spark):
    """Every code point, alone and between letters, in blocks of 512."""
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    codes = [*range(1, 0xD800), *range(0xE000, 0x110000)]
    rows = [(i, "x".join(map(chr, codes[i : i + 512]))) for i in range(0, len(codes), 512)]
    got = {r["i"]: r["s"] for r in spark.createDataFrame(rows, "i int, t string").select("i", X.strip_accents(F.col("t")).alias("s")).collect()}
    assert all(got[i] == plain(t) for i, t in rows)
