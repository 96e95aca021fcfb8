import numpy as np
import pytest

from cohortlab.operators import survival


def brute_km_censor(t, s):
    """G(u-) for each u: KM of censoring evaluated just before u."""
    times = np.unique(t)
    g = {}
    cur = 1.0
    for u in times:
        g[u] = cur
        risk = (t >= u).sum()
        dc = ((t == u) & (s == 0)).sum()
        cur *= 1 - dc / risk
    return g


def brute_fine_gray(t, s, X, iters=50):
    n, p = X.shape
    g = brute_km_censor(t, s)
    beta = np.zeros(p)
    ev_times = np.unique(t[s == 1])
    for _ in range(iters):
        U = np.zeros(p); I = np.zeros((p, p))
        r = np.exp(X @ beta)
        for u in ev_times:
            w = np.zeros(n)
            for j in range(n):
                if t[j] >= u:
                    w[j] = 1.0
                elif s[j] >= 2:
                    w[j] = g[u] / g[t[j]]
            s0 = (w * r).sum(); s1 = (w * r) @ X; s2 = (X.T * (w * r)) @ X
            d = ((t == u) & (s == 1)).sum()
            U += X[(t == u) & (s == 1)].sum(0) - d * s1 / s0
            I += d * (s2 / s0 - np.outer(s1, s1) / s0 ** 2)
        step = np.linalg.solve(I, U)
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    return beta, np.sqrt(np.diag(np.linalg.inv(I)))


@pytest.mark.parametrize("competing", [True, False])
def test_fine_gray_matches_brute_force(spark, competing):
    rng = np.random.default_rng(7)
    n = 120
    X = np.column_stack([rng.integers(0, 2, n), rng.integers(0, 2, n)]).astype(float)
    t = np.round(rng.exponential(10, n), 0) + 1.0  # integer days -> ties
    s = rng.choice([0, 1, 2] if competing else [0, 1], size=n, p=[0.3, 0.4, 0.3] if competing else [0.4, 0.6])
    rows = [(float(a), int(b), float(x1), float(x2)) for a, b, (x1, x2) in zip(t, s, X)]
    df = spark.createDataFrame(rows, "t double, s int, x1 double, x2 double")
    coefs, base, fits = survival.fine_gray(df, [], "t", "s", ["x1", "x2"])
    got = {r.term: r for r in coefs.collect()}
    beta, se = brute_fine_gray(t, s, X)
    assert got["x1"].estimate == pytest.approx(beta[0], abs=1e-8)
    assert got["x2"].estimate == pytest.approx(beta[1], abs=1e-8)
    assert got["x1"].std_error == pytest.approx(se[0], rel=1e-6)
    # prediction at the last event time
    pred = survival.predict_cif_last(df, coefs, base, ["x1", "x2"]).collect()
    assert all(0 < r.pred < 1 for r in pred)


def test_keys_fit_independently(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key in ("a", "b"):
        for _ in range(80):
            rows.append((key, float(rng.integers(1, 20)), int(rng.choice([0, 1, 2])), float(rng.integers(0, 2))))
    df = spark.createDataFrame(rows, "k string, t double, s int, x double")
    coefs, _b, _f = survival.fine_gray(df, ["k"], "t", "s", ["x"])
    joint = {r.k: r.estimate for r in coefs.collect()}
    for key in ("a", "b"):
        one, _, _ = survival.fine_gray(df.filter(f"k = '{key}'"), [], "t", "s", ["x"])
        assert joint[key] == pytest.approx(one.collect()[0].estimate, abs=1e-10)


def test_bucketed_running_sums_match(spark):
    """Force the multi-task prefix sums (tiny buckets) and compare with the brute force."""
    rng = np.random.default_rng(11)
    n = 150
    X = np.column_stack([rng.integers(0, 2, n), rng.normal(size=n)]).astype(float)
    t = np.round(rng.exponential(10, n), 1) + 0.5
    s = rng.choice([0, 1, 2], size=n, p=[0.3, 0.4, 0.3])
    df = spark.createDataFrame([(float(a), int(b), float(x1), float(x2)) for a, b, (x1, x2) in zip(t, s, X)],
                               "t double, s int, x1 double, x2 double")
    coefs, base, _ = survival.fine_gray(df, [], "t", "s", ["x1", "x2"], rows_per_bucket=7)
    got = {r.term: r.estimate for r in coefs.collect()}
    beta, _se = brute_fine_gray(t, s, X)
    assert got["x1"] == pytest.approx(beta[0], abs=1e-8) and got["x2"] == pytest.approx(beta[1], abs=1e-8)
    c1, b1, _ = survival.fine_gray(df, [], "t", "s", ["x1", "x2"])
    a = {r.time: r.cum_hazard for r in base.collect()}
    b = {r.time: r.cum_hazard for r in b1.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_running_sums_modes_agree(spark):
    from cohortlab.operators.agg import running_sums
    rows = [(k, float(i), float(i % 7)) for k in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t double, v double")
    for desc in (False, True):
        for inc in (False, True):
            one = {(r.k, r.t): r.cum_v for r in running_sums(df, ["k"], "t", ["v"], desc, inc).collect()}
            many = {(r.k, r.t): r.cum_v for r in running_sums(df, ["k"], "t", ["v"], desc, inc, bucketed=True).collect()}
            assert one == many


def test_ties_across_chunks(spark):
    """A third of the rows share one time, with distinct covariates, over chunks of five rows."""
    rng = np.random.default_rng(2)
    n = 90
    X = np.column_stack([rng.integers(0, 2, n), rng.normal(size=n)]).astype(float)
    t = np.where(np.arange(n) % 3 == 0, 6.0, np.round(rng.exponential(8, n)) + 1.0)
    s = rng.choice([0, 1, 2], size=n, p=[.2, .5, .3])
    df = spark.createDataFrame([(float(a), int(b), *map(float, x)) for a, b, x in zip(t, s, X)], "t double, s int, x1 double, x2 double")
    coefs, _, _ = survival.fine_gray(df, [], "t", "s", ["x1", "x2"], rows_per_bucket=5)
    got = {r.term: r for r in coefs.collect()}
    beta, se = brute_fine_gray(t, s, X)
    assert [got[x].estimate for x in ("x1", "x2")] == pytest.approx(beta, abs=1e-8)
    assert [got[x].std_error for x in ("x1", "x2")] == pytest.approx(se, rel=1e-6)


def test_keys_without_events_are_kept(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(rng.integers(1, 20)), int(rng.choice([0, 1, 2])), float(rng.integers(0, 2))) for _ in range(60)]
    rows += [("b", 3.0, 2, 1.0), ("b", 5.0, 0, 0.0)]
    df = spark.createDataFrame(rows, "k string, t double, s int, x double")
    coefs, base, fits = survival.fine_gray(df, ["k"], "t", "s", ["x"])
    f = {r.k: r for r in fits.collect()}
    assert f["a"].converged and not f["b"].converged and f["b"].n_events == 0 and f["b"].loglik is None
    pred = survival.predict_cif_last(df, coefs, base, ["x"], ["k"]).collect()
    assert len(pred) == len(rows) and all((r.pred == 0) == (r.k == "b") for r in pred)


def test_cif_at_a_time_is_a_step_function(spark):
    rng = np.random.default_rng(6)
    rows = [(float(rng.integers(2, 30)), int(rng.choice([0, 1, 2])), float(rng.integers(0, 2))) for _ in range(80)]
    df = spark.createDataFrame(rows, "t double, s int, x double")
    coefs, base, _ = survival.fine_gray(df, [], "t", "s", ["x"])
    beta = coefs.first().estimate
    steps = sorted((r.time, r.cum_hazard) for r in base.collect())
    at = spark.createDataFrame([(q, x) for q in (0.0, 2.0, 2.5, 17.0, 17.25, 99.0, None) for x in (0.0, 1.0)], "q double, x double")
    for r in survival.predict_cif(at, coefs, base, ["x"], at="q").collect():
        lam = max((h for u, h in steps if r.q is not None and u <= r.q), default=0.0)
        assert r.pred == pytest.approx(1 - np.exp(-lam * np.exp(beta * r.x)), abs=1e-12)
    fixed = survival.predict_cif(at, coefs, base, ["x"], at=17.25).collect()
    lam = max(h for u, h in steps if u <= 17.25)
    assert len(fixed) == 14 and all(r.pred == pytest.approx(1 - np.exp(-lam * np.exp(beta * r.x))) for r in fixed)
