"""Complete-case fits, uncapped tests and NULL-keeping labels."""
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortlab.functions import dist, fmt
from cohortlab.operators import agg, contingency, glm, reshape
from cohortlab.operators import relational as rel
from cohortlab.plans import catalog
from cohortlab.sources import io

SF = "/root/testdata/sf0.001"


def _with_missing(spark):
    rows = [(0.0, 0.0)] * 30 + [(0.0, 1.0)] * 20 + [(1.0, 0.0)] * 30 + [(1.0, 1.0)] * 40 + [(1.0, None)] * 40 + [(None, 1.0)] * 9
    return spark.createDataFrame(rows, "x double, y double")


def test_models_drop_incomplete_rows(spark):
    df = _with_missing(spark)
    slope = {r["term"]: r["estimate"] for r in glm.logit(df, "y", ["x"])[0].collect()}["x"]
    assert slope == pytest.approx(math.log((40 / 30) / (20 / 30)))
    assert glm.logit(df, "y", ["x"])[1].first()["n_obs"] == 120
    slope = {r["term"]: r["estimate"] for r in glm.ols_grouped(df, [], "y", ["x"])[0].collect()}["x"]
    assert slope == pytest.approx(40 / 70 - 20 / 50)
    assert tuple(glm.dropped_cases(df, [], ["y", "x"]).first()) == (120, 49)


def test_chi2_tail_at_many_degrees_of_freedom(spark):
    df = spark.createDataFrame([(1500.0, 1501), (2000.0, 2000), (4100.0, 4000), (10.0, 4000), (9000.0, 4000)], "x double, k int")
    got = [r[0] for r in df.select(dist.chi2_sf("x", "k")).collect()]
    # Wilson-Hilferty as an independent check
    for (x, k), p in zip([(1500.0, 1501), (2000.0, 2000), (4100.0, 4000)], got):
        z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
        assert p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=2e-5)
    assert got[3] == pytest.approx(1.0) and 0 <= got[4] < 1e-200


def test_fisher_of_a_very_large_table(spark):
    """1e11 persons; the same table in pieces of 1,000 support values; tables whose observed count is at an end."""
    rows = [("large", 5_000_000, 5_000_000, 5_000_000, 100_000_000_000), ("zero", 0, 7, 5, 9), ("full", 6, 0, 2, 9), ("one", 0, 0, 4, 5), ("none", 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "g string, a long, b long, c long, d long")
    got = {r.g: r for r in contingency.fisher_exact(df).collect()}
    est, low, high, p = (got["large"][c] for c in ("estimate", "conf_low", "conf_high", "p_value"))
    assert est == pytest.approx(20000, rel=1e-5) and p < 1e-300
    half = 1.959964 * math.sqrt(3 / 5e6 + 1e-11)
    assert low == pytest.approx(20000 * math.exp(-half), rel=1e-5) and high == pytest.approx(20000 * math.exp(half), rel=1e-5)
    assert (got["zero"].estimate, got["zero"].conf_low) == (0.0, 0.0) and 0 < got["zero"].conf_high < math.inf
    assert got["full"].estimate == got["full"].conf_high == math.inf and got["full"].conf_low > 0
    assert [got[g].p_value for g in ("one", "none")] == [1.0, 1.0]
    step, contingency.FISHER_STEP = contingency.FISHER_STEP, 1000
    try:
        again = contingency.fisher_exact(df.filter("g in ('large', 'zero')")).collect()
    finally:
        contingency.FISHER_STEP = step
    for r in again:
        assert [r[c] for c in ("estimate", "conf_low", "conf_high", "p_value")] == pytest.approx([got[r.g][c] for c in ("estimate", "conf_low", "conf_high", "p_value")], rel=1e-9)


def test_comparisons_need_two_arms(spark):
    cont = spark.createDataFrame([("g", "a", 1), ("g", "b", 2), ("g", "c", 3)], "group string, arm string, n long")
    with pytest.raises(ValueError):
        contingency.one_vs_rest_2x2(cont, {"x": ["a", "b", "c"]})


def test_bind_one_row(spark):
    df, one = spark.range(3), spark.createDataFrame([(7,)], "v int")
    assert [tuple(r) for r in rel.bind_one_row(df, one).orderBy("id").collect()] == [(0, 7), (1, 7), (2, 7)]
    assert rel.bind_one_row(df, one.limit(0)).count() == 0
    with pytest.raises(Exception, match="more than one row"):
        rel.bind_one_row(df, one.union(one)).collect()
    grid = rel.with_config(df, [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}])
    assert grid.columns == ["id", "a", "b"] and grid.count() == 6


def test_null_pieces_and_quoted_separators(spark):
    df = spark.createDataFrame([("A", None, "a.b"), ("A", "P", "c.d")], "abo string, rh string, t string")
    assert [r[0] for r in reshape.unite(df, "u", ["abo", "rh"], sep="|").select("u").collect()] == [None, "A|P"]
    assert [tuple(r) for r in reshape.split_cols(df, "t", ["x", "y"], sep=".").select("x", "y").collect()] == [("a", "b"), ("c", "d")]
    assert reshape.split_rows(df.select("t"), "t", ".").count() == 4
    g = agg.grouped_levels(df, {"both": ["abo", "rh"]}, [F.count(F.lit(1)).alias("n")])
    assert {r["group"] for r in g.collect()} == {None, "A-P", "TOTAL"}


def test_read_table_from_a_uri(spark):
    assert io.read_table(spark, f"file:{SF}", "region").count() == 5


def test_quantiles_equal_percentile(spark):
    df = spark.range(1001).select((F.col("id") % 4).alias("k"), F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 101) / 3.0).alias("v"))
    want = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p")).collect()}
    got = agg.quantiles(df, ["k"], ["v"], {"a": 0.1, "b": 0.5, "c": 0.9}).collect()
    for k, p in want.items():
        assert [r["value"] for s in "abc" for r in got if r["k"] == k and r["statistic"] == s] == pytest.approx(p)


def test_fixed_format_rounds_the_binary_value(spark):
    values = [688.85, 2529.35, 0.25, 0.35, -0.04, 2.5, 1e20, 0.125, -1234.56]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(fmt.fmt_fixed("v", 1)).collect()
    assert [r[0] for r in got] == ["%.1f" % v for v in values]
    assert Decimal(0.35) < Decimal("0.35")


def test_time_to_event_plan_is_flat(spark):
    plan = catalog.basic_time_to_event(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 12
    flags = catalog.prevalence_flags(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert flags.count("Relation [") == 1
