"""Operators behind the published tables: quantiles over families, bounded texts, code matching, many models at once."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.functions import fmt
from cohortlab.operators import agg, glm, relational as rel
from cohortlab.plans import analysis, report
from test_analysis import wide  # noqa: F401  the clinical fixture


def test_grouped_quantiles_over_families(spark):
    """Levels, joint levels and TOTAL; one level holds most rows, NULL levels and values."""
    r = np.random.default_rng(1)
    rows = [("x" if i % 4 else "y", None if i % 7 == 0 else str(i % 3), None if i % 11 == 0 else float(np.round(r.exponential(5), 1))) for i in range(700)]
    df = spark.createDataFrame(rows, "a string, b string, v double")
    got = {(x.family, x.group, x.statistic): x.value for x in agg.grouped_quantiles(df, {"a": ["a"], "b": ["b"], "ab": ["a", "b"]}, ["v"], {"q1": .25, "m": .5}).collect()}
    for fam, key in (("a", lambda t: t[0]), ("b", lambda t: t[1]), ("ab", lambda t: None if t[1] is None else f"{t[0]}-{t[1]}"), ("TOTAL", lambda t: "TOTAL")):
        for g in {key(t) for t in rows if not (fam in ("b", "ab") and t[1] is None)}:
            v = [t[2] for t in rows if key(t) == g and t[2] is not None]
            assert got[fam, g, "q1"] == pytest.approx(np.quantile(v, .25)) and got[fam, g, "m"] == pytest.approx(np.median(v))


def test_join_text_is_ordered_counted_and_bounded(spark):
    rows = [("k", 2, "b"), ("k", 1, "z"), ("k", 2, "a"), ("k", 1, "z"), ("k", 3, None), (None, 1, "n")]
    df = spark.createDataFrame(rows, "k string, o int, t string")
    assert {r.k: r.t for r in agg.join_text(df, ["k"], "t", order="o").collect()} == {"k": "z, z, a, b", None: "n"}
    assert {r.k: r.t for r in agg.join_text(df, ["k"], "t", order="o", distinct=True).collect()} == {"k": "z, a, b", None: "n"}
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 9).alias("o"), F.lit("same").alias("t"))
    assert {r.k: r.t.count("same") for r in agg.join_text(hot, ["k"], "t", order="o", max_texts=3).collect()}["hot"] == 1000
    with pytest.raises(Exception, match="more than 2 texts"):
        agg.join_text(hot, ["k"], "t", order="o", max_texts=2).collect()


def test_match_codes_keeps_the_unmatched(spark):
    ev = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a"), (5, "q")], "id int, c string")
    codes = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "code string")
    m = rel.match_codes(ev, F.upper("c"), codes.select(F.upper("code").alias("code")), "code")
    assert {r.id: r.matched for r in m.collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    rep = {r.matched: r for r in rel.match_report(m).collect()}
    assert (rep[True].n_rows, rep[True].n_codes, rep[False].n_rows, rep[False].n_without_code, rep[False].n_codes) == (2, 1, 3, 1, 2)
    assert rel.match_report(rel.match_codes(ev.limit(0), F.col("c"), codes, "code")).collect() == []


def test_adaptive_by_first_uses_the_declared_order(spark):
    rows = [(2, 0.5, 250.0, 3.0, 12.5, None), (1, 0.25, 120.26, 7.0, 50.5, 4.0), (3, 30.0, 1.0, 2.6, 1.5, 2.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, e double")
    got = {r.k: (r.a_text, r.b_text, r.c_text, r.d_text) for r in fmt.adaptive_by_first(df, ["a", "b", "c", "d"], ["k"]).collect()}
    assert got == {1: ("25.0", "120.3", "7", "50"), 2: ("50.0", "250.0", "3", "12"), 3: ("3000.0", "1.0", "2", "2")}
    back = {r.k: r.a_text for r in fmt.adaptive_by_first(df.withColumn("o", -F.col("k")), ["a"], ["o"]).collect()}
    assert back == {1: "0", 2: "0", 3: "30"}        # the first row is now the whole number 30


def test_n_pct_rounds_the_binary_value(spark):
    df = spark.createDataFrame([(1, 2.45), (1, 12.25), (1, 2.35)], "n int, p double")
    assert [r[0] for r in df.select(fmt.n_pct("n", "p")).collect()] == [f"1 ({x:.1f})" for x in (2.45, 12.25, 2.35)]


def test_responses_share_one_pattern_table(spark):
    """The same coefficients as one model each; patterns, not rows, are repeated."""
    r = np.random.default_rng(3)
    rows = [(*[float(v) for v in r.integers(0, 2, 3)], float(r.integers(0, 3)), float(r.integers(0, 2))) for _ in range(600)]
    df = spark.createDataFrame(rows, "y0 double, y1 double, y2 double, x1 double, x2 double")
    both, fits = glm.logit_responses(df, ["y0", "y1", "y2"], ["x1", "x2"])
    got = {(x.response, x.term): (x.estimate, x.std_error) for x in both.collect()}
    for y in ("y0", "y1", "y2"):
        one, _ = glm.logit(df, y, ["x1", "x2"])
        for x in one.collect():
            assert got[y, x.term] == pytest.approx((x.estimate, x.std_error), rel=1e-9)
    assert {x.response: x.n_obs for x in fits.collect()} == {"y0": 600.0, "y1": 600.0, "y2": 600.0}


def test_many_model_keys_and_a_null_key(spark):
    """Thousands of models in one fit, without a row per key on the driver; one key is hot, one NULL, one separated."""
    n = 4000
    rows = spark.range(n * 12).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.when(F.col("id") % n == 5, None).otherwise(F.col("id") % n)).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(2)).cast("double").alias("x"), (F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(3)) == 0).cast("double").alias("y"))
    rows = rows.unionByName(spark.createDataFrame([(-7, 0.0, 0.0), (-7, 1.0, 1.0), (-7, 0.0, 0.0), (-7, 1.0, 1.0)], "k long, x double, y double"))
    coefs, fits = glm.logit_grouped(rows, ["k"], "y", ["x"], max_iter=8)
    f = {r.k: r for r in fits.collect()}
    counts = {r.k: r for r in rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert f.keys() == counts.keys() and None in f and all(f[k].n_obs == counts[k].n for k in f)
    est = {(r.k, r.term): r.estimate for r in coefs.filter("k is null or k in (-1)").collect()}
    for k in (-1, None):
        cells = {r.x: (r.s, r.n) for r in rows.filter(F.col("k").eqNullSafe(F.lit(k))).groupBy("x").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
        if all(0 < s < m for s, m in cells.values()) and len(cells) == 2:
            logit = lambda s, m: math.log(s / (m - s))
            assert est[k, "x"] == pytest.approx(logit(*cells[1.0]) - logit(*cells[0.0]), abs=1e-6)
    assert not f[-7].converged
    ols, ofits = glm.ols_grouped(rows, ["k"], "y", ["x"])
    assert ofits.count() == len(f) and ols.filter("k = -7 and term = 'x'").first().estimate == pytest.approx(1.0)


def test_group_on_risk_factors(wide):  # noqa: F811
    coefs = analysis.blood_group_risk_factors(wide)
    got = {(r.blood_group_type, r.blood_group, r.term): r.estimate for r in coefs.collect()}
    assert len({k[:2] for k in got}) == 14 and len({k[2] for k in got}) == 15
    pdf = wide.toPandas()
    X = np.column_stack([np.ones(len(pdf)), (pdf.age - pdf.age.mean()) / pdf.age.std(), pdf.male_sex,
                         *[(pdf.ethnicity == v) for v in ("hs", "other", "missing")], *[(pdf.race == v) for v in ("asian", "black_aa", "other", "missing")],
                         *[pdf[f"risk_factor_{c}"] for c in ("cardiovascular_disorders", "diabetes_mellitus", "hypertension", "obesity", "respiratory_disorders")]]).astype(float)
    y = (pdf.abo == "A").to_numpy(float)
    b = np.zeros(X.shape[1])
    for _ in range(30):
        mu = 1 / (1 + np.exp(-X @ b))
        b += np.linalg.solve((X.T * (mu * (1 - mu))) @ X, X.T @ (y - mu))
    assert got["abo", "A", "(Intercept)"] == pytest.approx(b[0], abs=1e-5) and got["abo", "A", "male_sex"] == pytest.approx(b[2], abs=1e-5)


def test_race_stratified_associations(wide):  # noqa: F811
    coefs, fits = analysis.race_stratified_associations(wide, {"univariate": ["had_blood_group"]})
    pdf = wide.toPandas()
    f = {(r.outcome, r.race_ethnicity, r.blood_group): r for r in fits.collect()}
    assert len(f) == 3 * 9 * 14
    assert f["cov_pos", "race_white", "A"].n_obs == (pdf.race == "white").sum()
    assert f["died", "ethnicity_hs", "A"].n_obs == ((pdf.ethnicity == "hs") & pdf.cov_pos).sum()
    sub = pdf[pdf.race == "white"]
    logit = lambda p: math.log(p / (1 - p))
    want = logit(sub[sub.abo == "O"].cov_pos.mean()) - logit(sub[sub.abo != "O"].cov_pos.mean())
    got = {(r.outcome, r.race_ethnicity, r.blood_group, r.term): r.estimate for r in coefs.collect()}
    assert got["cov_pos", "race_white", "O", "had_blood_group"] == pytest.approx(want, abs=1e-6)
    frame = analysis.stratified_effect_frame(coefs).collect()
    assert {r.blood_group for r in frame} == {"A", "B", "O", "neg"} and {r.race_ethnicity for r in frame} & {"race_asian", "ethnicity_other"} == set()
    assert {(r.blood_group_type, r.type_order) for r in frame} == {("abo", 1), ("rh", 2)}
    assert len(frame) == 3 * 7 * 4


def test_count_texts(spark):
    cont = spark.createDataFrame([("f", "A", "pos", 1), ("f", "B", "pos", 2), ("f", "A", "neg", 0), ("f", "B", "neg", 0), ("f", None, "pos", 1)],
                                 "family string, group string, arm string, n long")
    got = {r.arm: r.text for r in report.count_texts(cont, ["pos", "neg"]).collect()}
    assert got["pos"] == "A:1 (25%), B:2 (50%)"
