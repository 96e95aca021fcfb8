import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import glm, resample, vectors


def test_multiplicities_are_poisson_and_fixed():
    persons, its = np.arange(20_000), np.arange(0, 41)
    w = vectors.multiplicities(persons, its, seed=7)
    assert (w[:, 0] == 1).all()
    assert abs(w[:, 1:].mean() - 1) < 0.01 and abs(w[:, 1:].var() - 1) < 0.02
    assert (w[:, 1:] == 0).mean() == pytest.approx(np.exp(-1), abs=0.002)
    cor = np.corrcoef(w[:, 1:].T) - np.eye(40)
    assert np.abs(cor).max() < 0.05                         # iterations are unrelated
    assert (vectors.multiplicities(persons[5:9], its[3:5], 7) == w[5:9, 3:5]).all()
    high = vectors.multiplicities(np.array([1, 1 + (1 << 32), 1 - (1 << 40)]), np.arange(1, 2001), 0)
    assert np.abs(np.corrcoef(high) - np.eye(3)).max() < 0.1    # both halves of the key count


def test_pattern_vectors_sum_the_persons(spark):
    """One pattern holds a third of the persons; rows with a missing value stay out; partitioning does not matter."""
    rows = [(i, float(i % 3 == 0), None if i % 50 == 7 else float(i % 5)) for i in range(5000)]
    df = spark.createDataFrame(rows, "person long, y double, x double")
    n_boot = 130
    for frame in (df, df.repartition(5)):
        got = {}
        for r in vectors.pattern_vectors(frame, "person", ["y", "x"], n_boot, seed=3).collect():
            assert (r.y, r.x, r.blk) not in got
            got[r.y, r.x, r.blk] = np.array(r.w)
        size = vectors.Blocks(n_boot).size
        full = [i for i, _, x in rows if x is not None]
        w = vectors.multiplicities(np.array(full), np.arange(n_boot + 1), 3)
        for y, x in {(y, x) for _, y, x in rows if x is not None}:
            at = [j for j, i in enumerate(full) if rows[i][1:] == (y, x)]
            whole = np.concatenate([got[y, x, b] for b in range(vectors.Blocks(n_boot).count)])
            assert np.array_equal(whole[:n_boot + 1], w[at].sum(axis=0)) and not whole[n_boot + 1:].any() and len(whole) % size == 0
    long = vectors.iteration_rows(vectors.pattern_vectors(df, "person", ["y", "x"], n_boot, seed=3), n_boot)
    assert long.count() == 10 * (n_boot + 1) and long.agg(F.max("bootstrap_iteration")).first()[0] == n_boot


def test_text_person_keys_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), (None, 2.0)], "person string, x double")
    r = vectors.iteration_rows(vectors.pattern_vectors(df, "person", ["x"], 5), 5).filter("bootstrap_iteration = 0").collect()
    assert {x.x: x.boot_w for x in r} == {1.0: 2.0, 2.0: 1.0}
    assert vectors.pattern_vectors(df.limit(0), "person", ["x"], 5).collect() == []


def test_running_vectors_over_small_chunks(spark):
    r = np.random.default_rng(5)
    rows = [(k, float(t), r.random(3).tolist()) for k in ("a", "b") for t in np.unique(r.integers(0, 400, 150))] + [("c", 1.0, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "k string, t double, v array<double>")
    for descending in (False, True):
        for inclusive in (False, True):
            got = {(x.k, x.t): x.c for x in vectors.running(df, ["k"], "t", "v", "c", descending, inclusive, rows=7).collect()}
            assert len(got) == len(rows)
            for k, t, v in rows:
                on = [np.array(w) for q, u, w in rows if q == k and ((u > t if descending else u < t) or (inclusive and u == t))]
                assert np.allclose(got[k, t], sum(on, np.zeros(3)))


def test_risk_grid_against_refits(spark):
    """Linear and Fine-Gray standardised risks of some resamples, refitted from the drawn multiplicities."""
    from cohortlab.plans import risk
    from test_survival import brute_fine_gray, brute_km_censor
    rng = np.random.default_rng(1)
    n, n_boot = 90, 70
    g, c = rng.integers(0, 2, n), rng.integers(0, 2, n)
    y = (rng.random(n) < 0.3 + 0.2 * g).astype(float)
    t, s = np.round(rng.exponential(8, n)) + 1.0, rng.choice([0, 1, 2], size=n, p=[.3, .4, .3])
    df = spark.createDataFrame([(i, *map(float, v[:4]), int(v[4])) for i, v in enumerate(zip(y, g, c, t, s))],
                               "person long, y double, g double, c double, t double, s int")
    grid = risk.Grid({"e": ["g"]}, {"e": {"e0": {"g": 0.0}, "e1": {"g": 1.0}}}, {"plain": [], "adjusted": ["c"]})
    w = vectors.multiplicities(np.arange(n), np.arange(n_boot + 1), 0)
    lin = {tuple(r)[1:4]: r.risk for r in risk.linear_risks(df, "y", "person", grid, n_boot).collect()}
    fg = {tuple(r)[2:5]: r.risk for r in risk.fine_gray_risks({"o": df}, "person", "t", "s", grid, n_boot, rows_per_chunk=11).collect()}
    assert len(lin) == len(fg) == 2 * 2 * (n_boot + 1)
    for it in (0, 1, 64, 70):
        rep = np.repeat(np.arange(n), w[:, it].astype(int))
        for model, cols in (("plain", [g]), ("adjusted", [g, c])):
            X = np.column_stack(cols).astype(float)
            beta = np.linalg.lstsq(np.column_stack([np.ones(len(rep)), X[rep]]), y[rep], rcond=None)[0]
            b2, _ = brute_fine_gray(t[rep], s[rep], X[rep], 25)
            km = brute_km_censor(t[rep], s[rep])
            lam, r = 0.0, np.exp(X[rep] @ b2)
            for u in np.unique(t[rep][s[rep] == 1]):
                wt = np.where(t[rep] >= u, 1.0, np.where(s[rep] >= 2, km[u] / np.array([km[x] for x in t[rep]]), 0.0))
                lam += ((t[rep] == u) & (s[rep] == 1)).sum() / (wt * r).sum()
            for level in (0.0, 1.0):
                Z = X[rep].copy()
                Z[:, 0] = level
                assert lin[model, it, f"e{int(level)}"] == pytest.approx((np.column_stack([np.ones(len(rep)), Z]) @ beta).mean(), abs=1e-9)
                assert fg[model, it, f"e{int(level)}"] == pytest.approx((1 - np.exp(-lam * np.exp(Z @ b2))).mean(), abs=2e-5)


def test_failed_iterations_are_counted(spark):
    """A level with two persons is missing from some resamples; an outcome without events never fits."""
    from cohortlab.plans import risk
    df = spark.createDataFrame([(i, float(i % 2), float(i in (3, 8)), float(1 + i % 4), 2) for i in range(40)],
                               "person long, y double, g double, t double, s int")
    strata = {"e": {"e0": {"g": 0.0}, "e1": {"g": 1.0}}}
    out = risk.risk_grid(df.withColumnRenamed("y", "initial_cov_pos"), {"none": df.drop("y")}, "person", {"e": ["g"]}, strata, {"e": "e0"},
                         {"plain": []}, 200, time="t", status="s").collect()
    rows = {(r.outcome, r.stratum): r for r in out}
    w = vectors.multiplicities(np.array([3, 8]), np.arange(1, 201), 0)
    gone = int((w.sum(axis=0) == 0).sum())
    assert gone and rows["prevalence", "e1"].n_failed == gone and rows["prevalence", "e1"].n_boot_used == 200 - gone
    assert rows["prevalence", "e0"].n_failed == gone        # the whole fit counts as failed
    assert rows["none", "e1"].risk is None and rows["none", "e1"].n_failed == 200 and rows["none", "e1"].n_boot_used == 0


def test_standardised_mean_and_effects(spark):
    rng = np.random.default_rng(0)
    n = 500
    g = rng.integers(0, 3, n)
    c = rng.integers(0, 2, n).astype(float)
    y = (rng.random(n) < 0.2 + 0.1 * g + 0.1 * c).astype(float)
    df = spark.createDataFrame([(float(a == 1), float(a == 2), float(b), float(yy)) for a, b, yy in zip(g, c, y)],
                               "g1 double, g2 double, c double, y double")
    coefs, _ = glm.ols_grouped(df, [], "y", ["g1", "g2", "c"])
    strata = {"g0": {"g1": 0.0, "g2": 0.0}, "g1": {"g1": 1.0, "g2": 0.0}, "g2": {"g1": 0.0, "g2": 1.0}}
    risks = resample.standardised_mean(df, [], strata, lambda x: glm.predict_linear(x, coefs, ["g1", "g2", "c"]))
    X = np.column_stack([np.ones(n), g == 1, g == 2, c]).astype(float)
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    expect = {s: beta[0] + beta[1] * a["g1"] + beta[2] * a["g2"] + beta[3] * c.mean() for s, a in strata.items()}
    got = {r.stratum: r.risk for r in risks.collect()}
    for s in strata:
        assert got[s] == pytest.approx(expect[s], abs=1e-10)
    e = {r.stratum: r for r in resample.effects(risks, [], "g0").collect()}
    assert e["g0"].risk_difference == 0 and e["g0"].nnt is None
    assert e["g2"].relative_risk == pytest.approx(expect["g2"] / expect["g0"])
    assert e["g1"].nnt == pytest.approx(1 / (expect["g1"] - expect["g0"]))


def test_percentile_ci_is_type7(spark):
    rows = [(0, 5.0)] + [(i, float(v)) for i, v in enumerate([1, 2, 4, 10], start=1)]
    df = spark.createDataFrame(rows, "bootstrap_iteration int, risk double").withColumn("k", F.lit("a"))
    r = resample.percentile_ci(df, ["k"], ["risk"]).collect()[0]
    assert r.risk == 5.0
    assert r.risk_conf_low == pytest.approx(np.quantile([1, 2, 4, 10], 0.025))
    assert r.risk_conf_high == pytest.approx(np.quantile([1, 2, 4, 10], 0.975))
