from cohortlab.plans import report


def test_baseline_by_group(spark):
    df = spark.createDataFrame([("A", "pos", 1, 0), ("A", "neg", 1, 1), ("B", "pos", 0, 0), ("B", "pos", 1, 0)],
                               "abo string, rh string, cov_pos int, died int")
    rows = {(r.family, r.group, r.characteristic): r for r in
            report.baseline_by_group(df, {"abo": ["abo"], "rh": ["rh"]}, ["cov_pos", "died"]).collect()}
    assert rows[("abo", "A", "cov_pos")].cell == "2 (100.0)"
    assert rows[("abo", "B", "cov_pos")].cell == "1 (50.0)"
    assert rows[("rh", "pos", "died")].cell == "0 (0.0)"
    assert rows[("TOTAL", "TOTAL", "cov_pos")].cell == "3 (75.0)"
    first = {(r.family, r.group, r.characteristic): r.cell for r in
             report.baseline_by_group(df, {"abo": ["abo"]}, ["cov_pos"], style="round", percent_sign=True).collect()}
    assert first[("abo", "A", "cov_pos")] == "2 (100%)" and first[("abo", "B", "cov_pos")] == "1 (50%)"


def test_regression_table_text(spark):
    import math
    coefs = spark.createDataFrame([("A", math.log(1.5), 0.1, 0.0123)], "term string, estimate double, std_error double, p_value double")
    r = report.regression_table(coefs).collect()[0]
    assert r.or_text == "1.5" and r.p_text == "0.012"
    lo, hi = 1.5 * math.exp(-0.196), 1.5 * math.exp(0.196)
    assert r.ci_text == f"{lo:.2g} - {hi:.2g}"


def test_qc_report(spark):
    df = spark.createDataFrame([(1, 1, 0, None), (1, 0, 1, "A"), (2, 0, 1, "B")],
                               "pat long, cov_pos int, intubated int, abo string")
    q = {r.check: r.n for r in report.qc_report(df, "pat", {"intubated_not_positive": "intubated = 1 AND cov_pos = 0"}).collect()}
    assert q["rows"] == 3 and q["distinct_keys"] == 2 and q["duplicate_keys"] == 1
    assert q["null:abo"] == 1 and q["null:pat"] == 0 and q["implausible:intubated_not_positive"] == 2


def test_risk_table_and_adaptive(spark):
    from cohortlab.functions import fmt
    rows = [("aboA", True, 0.1234, 0.1, 0.15, 0.0, 0.0, 0.0, None, None, None, 1.0, 1.0, 1.0),
            ("aboB", False, 0.2, 0.15, 0.25, 0.0766, 0.02, 0.13, 13.05, 7.7, 50.0, 1.62, 1.1, 2.3)]
    cols = ("stratum string, is_reference boolean, risk double, risk_conf_low double, risk_conf_high double, "
            "risk_difference double, risk_difference_conf_low double, risk_difference_conf_high double, "
            "nnt double, nnt_conf_low double, nnt_conf_high double, relative_risk double, "
            "relative_risk_conf_low double, relative_risk_conf_high double")
    t = {r.stratum: r for r in report.risk_table(spark.createDataFrame(rows, cols)).collect()}
    assert t["aboA"].risk_text == "12.3 (10.0 to 15.0)" and t["aboA"].relative_risk_text == "—"
    assert t["aboB"].risk_difference_text == "7.7 (2.0 to 13.0)"
    assert t["aboB"].relative_risk_text == "1.62 (1.10 to 2.30)"
    df = spark.createDataFrame([(12, 48)], "n long, total long")
    assert df.select(fmt.count_share("n", "total")).collect()[0][0] == "12 (25.0)"
