
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import glm
from golden import ABO_ONLY_COEF_0412, ABO_VS_NULL_0412, COUNTS_0412, NULL_INTERCEPT_COV_0412

GROUPS = ["A", "B", "O", "AB"]


@pytest.fixture(scope="module")
def weighted(spark):
    """Person-equivalent weighted rows: (outcome, abo, y, w) from the published group counts."""
    agg = {}
    for abo, _rh, int_pos, _int, died_pos, _died, pos, tested, _gen in COUNTS_0412:
        a = agg.setdefault(abo, [0, 0, 0, 0])
        a[0] += pos; a[1] += tested; a[2] += int_pos; a[3] += died_pos
    rows = []
    for abo, (pos, tested, int_pos, died_pos) in agg.items():
        rows += [("covid_result_binary", abo, 1.0, float(pos)), ("covid_result_binary", abo, 0.0, float(tested - pos))]
        rows += [("intubation_binary", abo, 1.0, float(int_pos)), ("intubation_binary", abo, 0.0, float(pos - int_pos))]
        rows += [("died_binary", abo, 1.0, float(died_pos)), ("died_binary", abo, 0.0, float(pos - died_pos))]
    df = spark.createDataFrame(rows, "outcome string, abo string, y double, w double")
    for g in GROUPS:
        df = df.withColumn(g, (F.col("abo") == g).cast("double"))
    return df


def test_abo_only_golden(weighted):
    coefs, fits = glm.logit_grouped(weighted, ["outcome"], "y", GROUPS, weight="w")
    res = {(r.outcome, r.term): r for r in coefs.collect()}
    for outcome, term, est, se, z, p in ABO_ONLY_COEF_0412:
        r = res[(outcome, term)]
        assert r.estimate == pytest.approx(est, abs=1e-6)
        assert r.std_error == pytest.approx(se, rel=1e-5)
        assert r.p_value == pytest.approx(p, rel=1e-4)
    assert ("covid_result_binary", "AB") not in res  # aliased, dropped from the right
    f = {r.outcome: r for r in fits.collect()}
    for outcome, _ndf, _ndev, rdf, rdev, _df, _dev, _p in ABO_VS_NULL_0412:
        assert f[outcome].df_residual == rdf
        assert f[outcome].deviance == pytest.approx(rdev, abs=1e-6)
        assert f[outcome].rank == 4


def test_null_and_deviance_table(weighted):
    full = weighted.withColumn("model", F.lit("abo"))
    null = weighted.withColumn("model", F.lit("null"))
    for g in GROUPS:
        null = null.withColumn(g, F.lit(0.0))
    both = full.unionByName(null)
    coefs, fits = glm.logit_grouped(both, ["outcome", "model"], "y", GROUPS, weight="w")
    c = {(r.outcome, r.model, r.term): r for r in coefs.collect()}
    est, se = NULL_INTERCEPT_COV_0412
    r = c[("covid_result_binary", "null", "(Intercept)")]
    assert r.estimate == pytest.approx(est, abs=1e-8)
    assert r.std_error == pytest.approx(se, rel=1e-6)
    tab = glm.deviance_table(fits, {"abo_vs_null": ("null", "abo")}).collect()
    got = {(t.outcome, t.row): t for t in tab}
    for outcome, ndf, ndev, rdf, rdev, df, dev, p in ABO_VS_NULL_0412:
        a, b = got[(outcome, 1)], got[(outcome, 2)]
        assert a.resid_df == ndf and a.df is None and a.p_value is None
        assert a.resid_dev == pytest.approx(ndev, abs=1e-6)
        assert b.resid_df == rdf and b.df == df
        assert b.deviance == pytest.approx(dev, abs=1e-6)
        assert b.p_value == pytest.approx(p, rel=1e-6)


def test_matches_numpy_irls(spark):
    rng = np.random.default_rng(1)
    n = 400
    x1 = rng.normal(size=n); x2 = rng.integers(0, 2, size=n).astype(float)
    eta = -0.3 + 0.8 * x1 - 0.5 * x2
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)], "x1 double, x2 double, y double")
    coefs, fits = glm.logit(df, "y", ["x1", "x2"])
    X = np.column_stack([np.ones(n), x1, x2]); b = np.zeros(3)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-X @ b)); W = mu * (1 - mu)
        b = b + np.linalg.solve(X.T @ (W[:, None] * X), X.T @ (y - mu))
    got = {r.term: r.estimate for r in coefs.collect()}
    assert [got["(Intercept)"], got["x1"], got["x2"]] == pytest.approx(list(b), abs=1e-7)


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(2)
    n = 300
    x = rng.normal(size=(n, 2)); y = 1 + x @ np.array([0.5, -2.0]) + rng.normal(size=n)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "x1 double, x2 double, y double")
    coefs, fits = glm.ols_grouped(df, [], "y", ["x1", "x2"])
    X = np.column_stack([np.ones(n), x]); beta = np.linalg.lstsq(X, y, rcond=None)[0]
    got = {r.term: r for r in coefs.collect()}
    assert [got[t].estimate for t in ["(Intercept)", "x1", "x2"]] == pytest.approx(list(beta), abs=1e-9)
    resid = y - X @ beta; s2 = resid @ resid / (n - 3)
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * s2)
    assert got["x1"].std_error == pytest.approx(se[1], rel=1e-8)
