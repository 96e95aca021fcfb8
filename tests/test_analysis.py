import datetime as dt
import math

import numpy as np
import pytest

from cohortlab.plans import analysis


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(21)
    n = 900
    abo = rng.choice(["A", "AB", "B", "O"], n, p=[0.35, 0.1, 0.15, 0.4])
    rh = rng.choice(["pos", "neg"], n, p=[0.85, 0.15])
    cov = (rng.random(n) < np.where(abo == "A", 0.55, 0.45)).astype(int)
    rows = []
    for i in range(n):
        rows.append((i + 1, int(rng.integers(0, 2)), float(rng.normal(55, 15)),
                     str(rng.choice(["hs", "nonhs", "other", "missing"])),
                     str(rng.choice(["white", "black_aa", "asian", "other", "missing"])), str(abo[i]), str(rh[i]),
                     *[bool(rng.random() < 0.3) for _ in range(5)], bool(cov[i]),
                     bool(cov[i] and rng.random() < 0.3), bool(cov[i] and rng.random() < 0.2)))
    schema = ("pat_mrn_id long, male_sex int, age double, ethnicity string, race string, abo string, rh string, "
              + ", ".join(f"risk_factor_{c} boolean" for c in ["cardiovascular_disorders", "diabetes_mellitus",
                                                                "hypertension", "obesity", "respiratory_disorders"])
              + ", cov_pos boolean, intubated boolean, died boolean")
    return spark.createDataFrame(rows, schema)


def test_blood_group_associations(wide):
    coefs, fits = analysis.blood_group_associations(wide)
    f = fits.collect()
    assert len(f) == 3 * 14 * 2
    pdf = wide.toPandas()
    got = {(r.outcome, r.blood_group, r.formula, r.term): r.estimate for r in coefs.collect()}
    for g in ("A", "O"):
        had = pdf[pdf.abo == g].cov_pos.astype(float)
        rest = pdf[pdf.abo != g].cov_pos.astype(float)
        logit = lambda p: math.log(p / (1 - p))
        assert got[("cov_pos", g, "univariate", "had_blood_group")] == pytest.approx(
            logit(had.mean()) - logit(rest.mean()), abs=1e-6)
    # intubation models only among positives
    n_int = {r.blood_group: r.n_obs for r in f if r.outcome == "intubated" and r.formula == "univariate"}
    assert n_int["A"] == int(pdf.cov_pos.sum())
    assert ("cov_pos", "A", "multivariate", "age_normed") in got


def test_standardised_risk_grid(spark):
    rng = np.random.default_rng(4)
    n = 400
    rows, tests = [], []
    for i in range(n):
        entry = dt.datetime(2020, 4, 1) + dt.timedelta(hours=int(rng.integers(0, 24 * 60)))
        ic = entry + dt.timedelta(days=float(rng.uniform(0.5, 20)))
        dc = entry + dt.timedelta(days=float(rng.uniform(0.5, 20)))
        intub = float(rng.random() < 0.3)
        died = float(rng.random() < 0.2)
        rows.append((i, float(rng.uniform(20, 90)), float(rng.integers(0, 2)), str(rng.choice(analysis.RACE_V2)),
                     float(rng.integers(0, 2)), str(rng.choice(analysis.ABO_V2)), str(rng.choice(["pos", "neg"])),
                     entry, ic, intub, None, dc, died))
        tests.append((i, entry - dt.timedelta(hours=int(rng.integers(0, 200))),
                      "Test: positive" if rng.random() < 0.6 else "Test: negative"))
    basic = spark.createDataFrame(rows, "pat_mrn_id long, age double, male double, race string, hispanic double, "
                                        "abo string, rh string, cohort_entry_time timestamp, intubation_censor_time timestamp, "
                                        "intubated double, dnr_date timestamp, death_censor_time timestamp, died double")
    t = spark.createDataFrame(tests, "pat_mrn_id long, test_result_datetime timestamp, event_desc string")
    out = analysis.standardised_risk_grid(basic, t, n_boot=4).collect()
    assert len(out) == 3 * (4 * 2 + 2 * 2)
    ref = [r for r in out if r.is_reference]
    assert all(r.risk_difference == 0 for r in ref)
    assert all(r.risk is not None and 0 <= r.risk <= 1 for r in out if r.outcome != "prevalence")


def test_model_fit_comparisons(wide):
    tests, coefs, fits = analysis.model_fit_comparisons(wide)
    t = tests.collect()
    assert len(t) == 3 * 4 and all(r.df is not None and r.p_value is not None for r in t)
    f = {(r.outcome, r.model): r for r in fits.collect()}
    r = [x for x in t if x.outcome == "cov_pos" and x.comparison == "Risk factors vs Null"][0]
    assert r.deviance == pytest.approx(f[("cov_pos", "null")].deviance - f[("cov_pos", "Risk factors")].deviance)
    assert r.df == 14
    # ABO/Rh model: AB_neg and O_pos are not in the formula (reference groups)
    terms = {x.term for x in coefs.collect() if x.outcome == "cov_pos" and x.model == "ABO/Rh"}
    assert "abo_rh_AB_neg" not in terms and "abo_rh_O_neg" in terms


def test_meta_analysis_with_external_sites(spark):
    local = spark.createDataFrame([("A", 337, 35508), ("B", 187, 16177), ("AB", 36, 4568), ("O", 507, 52232)],
                                  "blood_group string, patients long, controls long")
    studies, pooled, het = analysis.meta_analysis(local, site="NYP")
    s = {(r.target, r.study): r for r in studies.collect()}
    assert len({st for _t, st in s}) == 4
    # Shenzhen, group A: patients 82 of 285, controls 6728 of 23386
    a, b, c, d = 82, 285 - 82, 6728, 23386 - 6728
    assert s[("A", "Shenzhen")].odds_ratio == pytest.approx((a * d) / (b * c), rel=1e-12)
    h = {r.target: r for r in het.collect()}
    assert h["O"].df == 3 and h["O"].k == 4
