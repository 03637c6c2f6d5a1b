"""Text rules on known cases and against plain Python readings of them."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry import model
from quarry.functions import text as tx


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def plain_years(text):
    units = ("million", "billion", "thousand", "%", "percent", "shares", "units", "bps", "basis points")
    out = set()
    for m in re.finditer(r"\b(?:19[5-9]\d|20[0-4]\d)\b", text):
        if text[max(0, m.start() - 6) : m.start()].rstrip().endswith("$"):
            continue
        if text[m.end() : m.end() + 20].lstrip().lower().startswith(units):
            continue
        out.add(int(m.group()))
    for m in re.finditer(r"\bFY\s?(\d\d)\b", text, re.I):
        y = int(m.group(1))
        out.add(1900 + y if y > 50 else 2000 + y)
    return sorted(out)


@pytest.mark.parametrize("text,want", [("in $ 2016 and 2017 million, FY19", [2019]), ("FY51 1949 2050 FY2015 FY 2015", [1951, 2015]), ("2015, 2014 and 2015", [2014, 2015]), ("", [])])
def test_years(spark, text, want):
    assert one(spark, text, tx.years) == want == plain_years(text)


_PARTS = st.sampled_from(["2015", "$", " ", "  ", "\t", "\n", "1999", "million", "MILLION", "basis points", "bps", "FY", "19", "fy07", "é", "x", ",", ".", "%", " ", "2016.5", "          "])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(_PARTS, max_size=9).map("".join), min_size=20, max_size=40))
def test_years_equal_a_plain_reading(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", tx.years(F.col("x")).alias("y")).collect()
    assert all(r.y == plain_years(r.x) for r in rows)


@pytest.mark.parametrize("text,want", [("Net sales of 6,951 and 384.3!", ["net", "sales", "of", "6951", "and", "384.3"]), ("1,234,567", ["1234567"]), ("A, B", ["a", "b"])])
def test_words(spark, text, want):
    assert one(spark, text, tx.words) == want


def test_numeric_tokens(spark):
    assert one(spark, "12 123 2015 1,234 4.25 4.2 123 1850", lambda c: tx.numeric_tokens(tx.words(c))) == ["123", "1234", "4.25", "1850"]


@pytest.mark.parametrize(
    "cells,want",
    [(["(619", ")"], ["(619)"]), (["$", "6,635"], ["$6,635"]), (["-$", " ", "5"], ["-$5"]), (["a", "$"], ["a", "$"]), (["(1", "(2", ")"], ["(1", "(2)"]), (["$", "$", "3"], ["$$", "3"]), ([" ", ""], []), (["$", "(5", ")"], ["$(5", ")"])],
)
def test_clean_row(spark, cells, want):
    assert one(spark, cells, tx.clean_row, "array<string>") == want


@pytest.mark.parametrize("title,want", [("/s/ John Doe", True), ("F-12", True), ("12", True), ("page F-3", True), ("EX-1", False), ("FIN 48", False), ("AB5000", False), (" \n", True), ("555-1234", True), ("SEQ=1,EFW", True), ("Item 7", False)])
def test_furniture(spark, title, want):
    assert one(spark, title, tx.is_furniture) is want


@pytest.mark.parametrize(
    "text,want",
    [
        ("so\nANSWER: 13880", (13880.0, "ok")), ("ANSWER: INSUFFICIENT", (None, "refused")), ("", (None, "empty")), (" \n ", (None, "empty")), (None, (None, "empty")), ("13880", (None, "no_answer_line")), ("answer: Yes, it did", (1.0, "ok")),
        ("ANSWER: lower.", (0.0, "ok")), ("ANSWER: $ -1", (-1.0, "ok")), ("ANSWER: -$1,234.5%", (-1234.5, "ok")), ("ANSWER: (123)", (123.0, "ok")), ("ANSWER: unclear", (None, "no_number")), ("ANSWER: cannot say, 5 maybe", (5.0, "ok")), ("ANSWER:\n7", (7.0, "ok")), ("ANSWER: 1\nANSWER: 2", (1.0, "ok")),
    ],
)
def test_parse_answer(spark, text, want):
    assert tuple(one(spark, text, tx.parse_answer)) == want


def test_company_names(spark):
    assert one(spark, "AT&T's E*TRADE", tx.company_normal) == " at and t e trade "
    assert sorted(one(spark, "Home Depot, Inc., The", tx.aliases)) == ["home", "home depot", "home depot inc", "home depot inc the"]
    assert one(spark, "The Gap Inc", tx.aliases)[-2:] == ["gap inc", "gap"] or "gap" in one(spark, "The Gap Inc", tx.aliases)


@pytest.mark.parametrize("token,want", [("BRK.B", ["BRKB", "BRK"]), ("BRK-B", ["BRKB", "BRK"]), ("BRKB", ["BRKB", "BRK"]), ("GE", ["GE"])])
def test_ticker_forms(spark, token, want):
    assert one(spark, token, tx.ticker_forms) == want


def test_year_bonus(spark):
    df = spark.createDataFrame([(2014, [2015]), (2014, []), (2014, None), (None, [2015]), (2014, [2000, 2014])], "y int, q array<int>")
    assert [round(r[0], 6) for r in df.select(tx.year_bonus(F.col("y"), F.col("q"))).collect()] == [0.005, 0.0, 0.0, 0.0, 0.01]


def test_stems(spark):
    row = model.with_stem_parts(spark.createDataFrame([("V_2015_1403161",)], "filing_stem string")).first()
    assert (row.ticker, row.fiscal_year, row.cik) == ("V", 2015, 1403161)


def test_sse_and_values(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert df.select(tx.sse(F.lit("stage"), F.struct("n", "s"))).first()[0] == 'event: stage\ndata: {"n":1,"s":"a"}\n\n'
    rows = spark.createDataFrame([("sales of 1,234 here", 1234.0), ("12345", 1234.0), ("x 4.5 y", 4.5), ("-7", -7.0)], "t string, v double")
    assert [r[0] for r in rows.select(tx.mentions_value(F.col("t"), F.col("v"))).collect()] == [True, False, True, True]
