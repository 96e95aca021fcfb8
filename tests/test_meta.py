import math

import numpy as np
import pytest

from cohortlab.operators import meta

# external site counts for blood group A (cases = patients, controls = population); plus one site with a zero cell
STUDIES = [("s1", 670.0, 1775.0, 1188.0, 3694.0), ("s2", 45.0, 113.0, 1188.0, 3694.0),
           ("s3", 82.0, 285.0, 6728.0, 23386.0), ("s4", 0.0, 20.0, 30.0, 400.0)]


def numpy_dl(rows):
    y, v = [], []
    for _s, a, n1, c, n2 in rows:
        b, d = n1 - a, n2 - c
        inc = 0.5 if min(a, b, c, d) == 0 else 0.0
        a, b, c, d = a + inc, b + inc, c + inc, d + inc
        y.append(math.log(a * d / (b * c)))
        v.append(1 / a + 1 / b + 1 / c + 1 / d)
    y, v = np.array(y), np.array(v)
    w = 1 / v
    mu_f = (w * y).sum() / w.sum()
    q = (w * (y - mu_f) ** 2).sum()
    k = len(y)
    tau2 = max(0.0, (q - (k - 1)) / (w.sum() - (w ** 2).sum() / w.sum()))
    wr = 1 / (v + tau2)
    mu = (wr * y).sum() / wr.sum()
    se = math.sqrt(1 / wr.sum())
    return mu, se, q, tau2, max(0.0, (q - (k - 1)) / q), wr / wr.sum() * 100


def test_meta_binary_matches_numpy(spark):
    df = spark.createDataFrame([("A", *s) for s in STUDIES],
                               "target string, study string, event_e double, n_e double, event_c double, n_c double")
    studies, pooled, het = meta.meta_binary(df)
    mu, se, q, tau2, i2, wts = numpy_dl(STUDIES)
    p = pooled.collect()[0]
    h = het.collect()[0]
    assert p.log_or == pytest.approx(mu, rel=1e-12)
    assert p.se == pytest.approx(se, rel=1e-12)
    assert p.p_value == pytest.approx(math.erfc(abs(mu / se) / math.sqrt(2)), rel=1e-10)
    assert h.q == pytest.approx(q, rel=1e-10) and h.tau2 == pytest.approx(tau2, rel=1e-10)
    assert h.i2 == pytest.approx(i2, rel=1e-10) and h.df == 3
    got_w = {r.study: r.weight_random for r in studies.collect()}
    for (s, *_), w in zip(STUDIES, wts):
        assert got_w[s] == pytest.approx(w, rel=1e-10)


def test_meta_single_study_is_defined(spark):
    df = spark.createDataFrame([("A", "s1", 5.0, 20.0, 3.0, 30.0)],
                               "target string, study string, event_e double, n_e double, event_c double, n_c double")
    _s, pooled, het = meta.meta_binary(df)
    h = het.collect()[0]
    assert h.df == 0 and h.tau2 == 0.0 and h.p_q is None
    assert pooled.collect()[0].odds_ratio == pytest.approx((5 * 27) / (15 * 3))
