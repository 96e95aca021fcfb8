import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cohortlab.functions import expr as X
from cohortlab.functions import fmt


def one(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_like_any_and_recode(spark):
    df = spark.createDataFrame([("A Pos",), ("a pos",), ("B neg",), (None,)], "t string")
    assert one(df, X.like_any("t", ["A%"])) == [True, False, False, None]
    assert one(df, X.like_any("t", ["A%"], case_insensitive=True)) == [True, True, False, None]
    rc = X.recode("t", [("A%", "A"), ("B%", "B")], kind="like")
    assert one(df, rc) == ["A", None, "B", None]
    assert one(df, X.recode("t", [("B neg", "b")], default="other")) == ["other", "other", "b", "other"]


def test_lab_value_rules(spark):
    df = spark.createDataFrame([("<6.5",), ("7.1%",), ("%",), (">14",), ("1.2.3",), ("see note",)], "v string")
    got = [None if v is None else float(v) for v in one(df, X.lab_value("v"))]
    assert got == [6.5, 7.1, None, 14.0, None, None]


def test_dates_and_nulls(spark):
    df = spark.createDataFrame([("0000-00-00", dt.datetime(2020, 4, 1, 0), dt.datetime(2020, 4, 5, 1)),
                                ("2020-04-02", dt.datetime(2020, 4, 1, 0), None)], "d string, a timestamp, b timestamp")
    assert one(df, X.zero_date("d")) == [None, dt.date(2020, 4, 2)]
    assert one(df, X.hours_between("b", "a")) == [97.0, None]
    assert one(df, X.pmin_na("a", "b")) == [dt.datetime(2020, 4, 1), None]   # Q13: NA if any NA
    assert one(df, F.least("a", "b")) == [dt.datetime(2020, 4, 1), dt.datetime(2020, 4, 1)]
    ages = spark.createDataFrame([(dt.date(2000, 6, 15),)], "b date")
    assert one(ages, X.age_years("b", F.lit("2020-06-14"), kind="calendar")) == [19]
    assert one(ages, X.age_years("b", F.lit("2020-06-14"))) == pytest.approx([7304 / 365.0])


def test_text_helpers(spark):
    df = spark.createDataFrame([("  hello   WORLD ", "Detected abc", "882-1")], "s string, r string, c string")
    r = df.select(X.squish("s").alias("sq"), X.sentence_case(X.squish("s")).alias("sc"),
                  X.extract_or_null("r", "(not detected|Detected)", 1).alias("ex"),
                  X.extract_or_null("s", "xyz").alias("none"),
                  X.multi_replace("r", [("Detected", "pos"), (r"\s+abc$", "")]).alias("mr"),
                  X.drop_check_digit("c").alias("code"), X.null_tokens(F.lit("(null)")).alias("nt")).collect()[0]
    assert r.sq == "hello WORLD" and r.sc == "Hello world" and r.ex == "Detected" and r.none is None
    assert r.mr == "pos" and r.code == 882 and r.nt is None
    assert one(df, X.map_recode(F.lit("x"), {"x": "y"})) == ["y"]
    assert one(df, X.map_recode(F.lit("z"), {"x": "y"}, default="keep")) == ["z"]


def test_formatting(spark):
    vals = [0.0123456, 1.0, 12345.0, 0.00001234, 123.456, -2.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert one(df, fmt.fmt_g("x", 2)) == ["%.2g" % v for v in vals]
    assert one(df, fmt.fmt_g("x", 3)) == ["%.3g" % v for v in vals]
    d = spark.createDataFrame([(12, 12.25)], "n long, p double")
    assert d.select(fmt.n_pct("n", "p")).collect()[0][0] == "12 (12.2)"   # 12.25 is a binary tie -> even
    assert d.select(fmt.n_pct("n", "p", percent_sign=True)).collect()[0][0] == "12 (12.2%)"
    assert spark.createDataFrame([(3, 12.0)], "n long, p double").select(
        fmt.n_pct("n", "p", style="round")).collect()[0][0] == "3 (12)"


def test_across_and_cols_like(spark):
    df = spark.createDataFrame([(1, 2, 3)], "risk_a int, risk_b int, other int")
    cols = X.cols_like(df, prefix="risk_")
    assert cols == ["risk_a", "risk_b"]
    out = X.across(df, cols, lambda c: c * 10).collect()[0]
    assert (out.risk_a, out.risk_b, out.other) == (10, 20, 3)


def test_dist_tails(spark):
    from cohortlab.functions import dist
    df = spark.createDataFrame([(3.84145882069412, 1), (5.99146454710798, 2), (0.0, 3)], "x double, k int")
    p = one(df, dist.chi2_sf("x", "k"))
    assert p[0] == pytest.approx(0.05, rel=1e-10) and p[1] == pytest.approx(0.05, rel=1e-10) and p[2] == 1.0
    z = one(df.limit(1), dist.norm_two_sided_p(F.lit(1.959963984540054)))
    assert z[0] == pytest.approx(0.05, rel=1e-10)
    me = df.limit(1).select(dist.mantissa_exponent(F.lit(math.log(3.2) - 400 * math.log(10.0)))).collect()[0][0]
    assert me.exponent == -400 and me.mantissa == pytest.approx(3.2, rel=1e-9)
