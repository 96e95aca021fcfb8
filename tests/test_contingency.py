import math

import pytest

from cohortlab.operators import contingency as K
from golden import (ABO_CHISQ_0412, ABO_FISHER_0412, ABO_RH_CHISQ_0412, ABO_RH_FISHER_0412, COMPARISONS,
                    COUNTS_0412)

ARMS = {
    "covid_positive": "covid_result_binary",
    "intubated_covid_positive": "intubation_binary_covid_pos",
    "died_covid_positive": "died_binary_covid_pos",
    "intubated": "intubation_binary",
    "died": "died_binary",
    "total_tested": "total_tested",
    "general_pop": "num_general",
}
COMPLEMENTS = {
    "covid_negative": ("total_tested", "covid_positive"),
    "not_intubated_covid_positive": ("covid_positive", "intubated_covid_positive"),
    "alive_covid_positive": ("covid_positive", "died_covid_positive"),
}


@pytest.fixture(scope="module")
def cont(spark):
    rows = spark.createDataFrame(COUNTS_0412, "abo string, rh string, intubation_binary_covid_pos long, "
                                 "intubation_binary long, died_binary_covid_pos long, died_binary long, "
                                 "covid_result_binary long, total_tested long, num_general long")
    c = K.contingency(rows, {"abo": ["abo"], "abo_rh": ["abo", "rh"]}, ARMS, COMPLEMENTS)
    abo_rh = K.min_cell(c.filter("family = 'abo_rh'"), "total_tested", 5)
    return c.filter("family = 'abo'").unionByName(abo_rh).cache()


def test_chisq_golden(cont):
    res = {(r.family, r.comparison): r for r in K.chisq(cont, COMPARISONS, keys=["family"]).collect()}
    for fam, gold in (("abo", ABO_CHISQ_0412), ("abo_rh", ABO_RH_CHISQ_0412)):
        for stat, p, df, comp in gold:
            r = res[(fam, comp)]
            assert r.parameter == df
            assert r.statistic == pytest.approx(stat, rel=1e-10)
            assert r.p_value == pytest.approx(p, rel=1e-10)
            assert r.method == "Pearson's Chi-squared test"


def test_fisher_golden(cont):
    tables = K.one_vs_rest_2x2(cont, COMPARISONS, keys=["family"])
    res = {(r.blood_group, r.comparison): r for r in K.fisher_exact(tables).collect()}
    for g, comp, est, lo, hi, p in ABO_FISHER_0412 + ABO_RH_FISHER_0412:
        r = res[(g, comp)]
        assert r.p_value == pytest.approx(p, rel=1e-9)
        assert r.estimate == pytest.approx(est, rel=2e-4)
        assert r.conf_high == pytest.approx(hi, rel=2e-4)
        assert r.conf_low == pytest.approx(lo, rel=2e-3)


def test_fisher_native_p_matches(cont):
    tables = K.one_vs_rest_2x2(cont, COMPARISONS, keys=["family"])
    native = {(r.blood_group, r.comparison): r.p_value for r in K.fisher_pvalue(tables).collect()}
    for g, comp, _e, _l, _h, p in ABO_FISHER_0412 + ABO_RH_FISHER_0412:
        assert native[(g, comp)] == pytest.approx(p, rel=1e-8)


def test_yates_2x2(spark):
    # R: chisq.test(matrix(c(12, 5, 7, 9), 2)) -> X-squared = 1.6, with Yates
    cont = spark.createDataFrame([("g1", "x", 12), ("g2", "x", 5), ("g1", "y", 7), ("g2", "y", 9)],
                                 "group string, arm string, n long")
    r = K.chisq(cont, {"c": ["x", "y"]}).collect()[0]
    o = [[12, 7], [5, 9]]
    n = 33.0
    e = [[19 * 17 / n, 19 * 16 / n], [14 * 17 / n, 14 * 16 / n]]
    y = min(0.5, min(abs(o[i][j] - e[i][j]) for i in range(2) for j in range(2)))
    stat = sum((abs(o[i][j] - e[i][j]) - y) ** 2 / e[i][j] for i in range(2) for j in range(2))
    assert r.statistic == pytest.approx(stat, rel=1e-12)
    assert r.p_value == pytest.approx(math.erfc(math.sqrt(stat / 2)), rel=1e-10)
    assert "Yates" in r.method


def test_fisher_pvalue_chunked_support(cont):
    """Support generated in many small chunks gives the same p as one chunk."""
    tables = K.one_vs_rest_2x2(cont, COMPARISONS, keys=["family"])
    one = {(r.blood_group, r.comparison): r.p_value for r in K.fisher_pvalue(tables).collect()}
    many = {(r.blood_group, r.comparison): r.p_value for r in K.fisher_pvalue(tables, chunk=37).collect()}
    assert one.keys() == many.keys()
    for k in one:
        assert many[k] == pytest.approx(one[k], rel=1e-12)


def test_chisq_sites_density_text(spark):
    # two sites with very different group distributions -> tiny p; reference prints the log density
    rows = [("A", "s1", 900), ("B", "s1", 50), ("C", "s1", 50), ("A", "s2", 100), ("B", "s2", 450), ("C", "s2", 450)]
    df = spark.createDataFrame(rows, "group string, site string, n long")
    r = K.chisq_sites(df, "s1", "s2").collect()[0]
    x, k = r.statistic, r.parameter
    ld = (k / 2 - 1) * math.log(x) - x / 2 - (k / 2) * math.log(2) - math.lgamma(k / 2)
    assert r.log_density == pytest.approx(ld, rel=1e-12)
    b = math.floor(ld / math.log(10))
    a = round(math.exp(ld - b * math.log(10)), 1)
    assert r.density_exponent == b and r.density_mantissa == pytest.approx(a)
    assert r.formatted == f"{a:g}e{b}"
