"""Types, predicates and null policies."""

import pytest
from pyspark.sql import functions as F

from sylvaframe import functions as fn
from sylvaframe.operators import encode, profile


@pytest.mark.parametrize(
    "values, kind",
    [
        (["1", "2", "10", "-1"], "Integral"),
        (["1", "2.5", "3"], "Rational"),
        (["1.", ".5", "3"], "Rational"),
        (["a", "1", "2"], "Categorical"),
        (["yes", "no", "yes"], "Binary"),
        (["yes", "no", None], "Categorical"),
        (["1", "2", "NA"], "Integral"),
        (["x", "x"], "Redundant"),
        ([None, "NULL", ""], "Redundant"),
        (["1e5", "2", "3"], "Categorical"),
        (["nan", "1", "2"], "Categorical"),
    ],
)
def test_types(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert profile.profile(df).first()["type"] == kind


@pytest.mark.parametrize("token", fn.NULL_TOKENS)
def test_null_tokens(spark, token):
    row = profile.profile(spark.createDataFrame([(token,), ("a",), ("b",), ("c",)], "c string")).first()
    assert row["has_null"] and row["cardinality"] == 3


def test_codex(spark):
    df = spark.createDataFrame([("10", "0.5", "no", "r", "a"), ("2", "1.5", "yes", "g", "b"), ("1", "1.0", "no", "b", "a")], "i string, r string, b string, c string, y string")
    book = profile.codex(df, "y")
    assert [str(p) for p in book.predicates] == ["i >= 2", "i >= 10", "r >= 0.75", "r >= 1.25", "b == yes", "c == b", "c == g", "c == r"]
    assert book.classes == ("a", "b")
    assert book.nearest("i", 9).reference == 10
    assert encode.decode_row(book, [1, 0, 1, 0, 1, 0, 1, 0]) == {"i": (">=", 2, 10), "r": (">=", 0.75, 1.25), "b": ("==", "yes"), "c": ("==", "g")}


def test_integral_keeps_least_with_nulls(spark):
    df = spark.createDataFrame([("3", "a"), ("5", "b"), ("7", "b"), (None, "a")], "i string, y string")
    assert [p.reference for p in profile.codex(df, "y").predicates] == [3, 5, 7]


def test_nulls_in_numbers(spark):
    df = spark.createDataFrame([("NaN", "NA"), (None, None), ("1.5", "2")], "r string, i string")
    r, i = profile.Predicate(0, "r", "Rational", ">=", -1.0), profile.Predicate(1, "i", "Integral", ">=", -1)
    got = df.select(r.column().alias("r"), i.column().alias("i"), r.column("sql").alias("rs"), i.column("sql").alias("is")).collect()
    assert [tuple(x) for x in got] == [(False, True, False, False), (True, True, False, False), (True, True, True, True)]


def test_significant_and_digits(spark):
    row = spark.range(1).select(fn.significant(F.lit(1234.5), 2), fn.significant(F.lit(-0.0456), 1), fn.significant(F.lit(0.0), 3), fn.digit(F.lit(9075), 2)).first()
    assert row[0] == 1200 and row[1] == pytest.approx(-0.05) and row[2] == 0 and row[3] == 0


def test_packed_words(spark):
    df = spark.range(100).select((F.col("id")).alias("x"), (F.col("id") % 2).alias("y"))
    book = profile.codex(df, "y")
    assert len(book) == 99
    rows = df.select("x", *encode.packed(book)).collect()
    assert all(bin(r["w0"]).count("1") + bin(r["w1"]).count("1") == r["x"] for r in rows)
