import datetime as dt

import pytest

from cohortlab.plans import cohort as C

T = dt.datetime
OUT = "2020-08-01"


@pytest.fixture(scope="module")
def t(spark):
    mk = spark.createDataFrame
    ca = mk([(40776356, 1001)], "ancestor_concept_id long, descendant_concept_id long")
    concept = mk([(1001, "LP1-1", "LOINC")], "concept_id long, concept_code string, vocabulary_id string")
    meas = mk([(101, 1001, "A Positive"), (102, 1001, "B Negative"), (103, 1001, "O Pos"), (103, 1001, "A Pos"),
               (104, 1001, "AB Neg"), (105, 1001, "A Pos"), (106, 1001, "A Pos"), (107, 1001, "B Pos")],
              "person_id long, measurement_concept_id long, value_source_value string")
    p2p = mk([(i, i + 100) for i in range(101, 108)], "person_id long, pat_mrn_id long")
    hosp = mk([], "pat_mrn_id long, component_loinc_code long, ord_value string, date_retrieved date")
    D = dt.date(2020, 7, 1)
    persons = mk([
        (201, "p1", "Male", dt.date(1950, 1, 1), "0000-00-00", "NOT HISPANIC OR LATINO OR SPANISH ORIGIN", "WHITE", None, None),
        (202, "p2", "Female", dt.date(1960, 1, 1), "2020-04-15", "HISPANIC OR LATINO OR SPANISH ORIGIN",
         "BLACK OR AFRICAN AMERICAN", "BLACK OR AFRICAN AMERICAN", "BLACK OR AFRICAN AMERICAN"),
        (203, "p3", "Male", dt.date(1970, 1, 1), "0000-00-00", "UNKNOWN", "WHITE", "WHITE", "WHITE"),
        (204, "p4", "Female", dt.date(1980, 1, 1), "0000-00-00", "DECLINED", "(null)", "DECLINED", "(null)"),
        (205, "AUTOMATEDLAB 1", "Male", dt.date(1990, 1, 1), "0000-00-00", "UNKNOWN", "WHITE", "WHITE", "WHITE"),
        (206, "p6", "Male", dt.date(1990, 1, 1), "0000-00-00", "UNKNOWN", "WHITE", "WHITE", "WHITE"),
    ], "pat_mrn_id long, pat_name string, sex_desc string, birth_date date, death_date string, ethnicity string, "
       "race_1 string, race_2 string, race_3 string")
    labs = mk([(201, "Detected", T(2020, 4, 5, 10), 1, D), (202, "Not detected", T(2020, 4, 1), 1, D),
               (202, "Detected", T(2020, 4, 10, 12), 1, D), (203, "Detected", T(2020, 4, 3), 1, D),
               (204, "Not detected", T(2020, 4, 3), 1, D), (205, "Detected", T(2020, 4, 3), 1, D),
               (206, "Invalid", T(2020, 4, 3), 1, D), (107, "Detected", T(2020, 4, 3), 1, D)],
              "pat_mrn_id long, ord_value string, result_datetime timestamp, comment_id long, date_retrieved date")
    adm = mk([(201, T(2020, 4, 2), T(2020, 4, 20))], "pat_mrn_id long, hosp_admsn_time timestamp, hosp_disch_time timestamp")
    orders = mk([(202, T(2020, 4, 12), C.DNR_DESCRIPTION), (201, T(2020, 4, 1), "other order")],
                "pat_mrn_id long, order_date timestamp, description string")
    io_ = mk([(201, T(2020, 4, 6), "Canceled", "x", "y", D), (201, T(2020, 4, 8), "Completed", "x", "y", D),
              (202, T(2020, 4, 9), None, "x", "y", D), (202, T(2020, 4, 25), None, "x", "y", D)],
             "pat_mrn_id long, order_date timestamp, order_status string, description string, display_name string, "
             "date_retrieved date")
    bd = mk([(202, T(2020, 4, 15))], "pat_mrn_id long, death_date timestamp")
    return {"concept_ancestor": ca, "concept": concept, "measurement": meas, "patient2person": p2p,
            "measurements": hosp, "persons": persons, "labs": labs, "admission": adm, "orders": orders,
            "intubation_orders": io_, "birth_death": bd}


def test_build_basic_v2(t):
    basic = {r.pat_mrn_id: r for r in C.build_basic_v2(t, OUT, OUT)["basic"].collect()}
    # 203 contradictory, 205 automated-lab stand-in, 206 no valid test, 207 has no persons row
    assert set(basic) == {201, 202, 204}
    a = basic[201]
    assert a.cohort_entry_time == T(2020, 4, 2)              # positive 82 h after admission -> admission
    assert a.intubation_censor_time == T(2020, 4, 8) and a.intubated == 1.0   # cancelled order ignored
    assert a.death_censor_time == T(2020, 4, 20) and a.died == 0.0              # encounter spans entry + 10 d
    assert a.race == "other" and a.abo == "A" and a.rh == "pos" and a.male == 1.0 and a.dnr_date is None
    b = basic[202]
    assert b.cohort_entry_time == T(2020, 4, 10, 12)         # no admission -> first positive
    assert b.intubated == 0.0 and b.intubation_censor_time == T(2020, 4, 20, 12)  # orders outside window
    assert b.died == 1.0 and b.death_censor_time == T(2020, 4, 15)
    assert b.dnr_date == T(2020, 4, 12) and b.race == "black" and b.hispanic == 1.0
    assert b.age == pytest.approx((dt.date(2020, 4, 15) - dt.date(1960, 1, 1)).days / 365)
    c = basic[204]
    assert c.cohort_entry_time is None and c.race == "missing"   # tested, never positive


def test_prevalence_and_competing(t):
    out = C.build_basic_v2(t, OUT, OUT)
    prev = {r.pat_mrn_id: r for r in C.prevalence_v2(out["tests"]).collect()}
    assert prev[202].cov_pos == 1.0 and prev[202].initial_cov_pos == 0.0   # positive > 96 h after first test
    assert prev[201].initial_cov_pos == 1.0
    cr = {r.pat_mrn_id: r for r in C.competing_risk_v2(out["basic"], "intubation").collect()}
    assert cr[201].outcome == "intubation" and cr[201].survival_time == pytest.approx(6.0)
    assert 202 not in cr          # DNR before censor excludes from the intubation analysis
    d = {r.pat_mrn_id: r for r in C.competing_risk_v2(out["basic"], "death").collect()}
    assert d[202].outcome == "death" and d[202].survival_time == pytest.approx(4.5)
    assert d[201].outcome == "recovery"


def test_general_population_v2(t, spark):
    g = {r.blood_type: r.N for r in C.general_population_v2(t, OUT).collect()}
    # persons 101-106 have labs (valid or not) -> tested; person 107 has none -> general population (B, pos)
    assert g == {"B": 1, "pos": 1}


def test_build_initial(spark):
    mk = spark.createDataFrame
    tests = mk([(1, "F", dt.date(1980, 4, 1), "0000-00-00", "Detected", 36072),
                (1, "F", dt.date(1980, 4, 1), "0000-00-00", "Not Detected", 36072),
                (2, "M", dt.date(1970, 1, 1), "2020-04-01", "Not Detected", 36072),
                (3, "M", dt.date(1960, 1, 1), "0000-00-00", "Detected", 36072),
                (4, "M", dt.date(1960, 1, 1), "0000-00-00", "Detected", 36195),
                (0, "M", dt.date(1960, 1, 1), "0000-00-00", "Detected", 36072)],
               "pat_mrn_id long, sex string, birth_date date, death_date string, ord_value string, comment_id long")
    bt = mk([(1, "A Positive"), (2, "O"), (3, "B Pos"), (3, "AB Neg")], "pat_mrn_id long, blood_type_value string")
    io_ = mk([(1, T(2020, 4, 2), "intubate", "ETT"), (2, T(2020, 4, 2), None, "ETT")],
             "pat_mrn_id long, order_date timestamp, description string, display_name string")
    got = {r.pat_mrn_id: r for r in C.build_initial(tests, bt, io_, "2020-04-12").collect()}
    assert set(got) == {1, 2}          # 3 has two blood types, 4 another comment id, 0 the error row
    a, b = got[1], got[2]
    assert (a.abo, a.rh, a.covid_result_binary, a.intubation_binary, a.died_binary) == ("A", "pos", 1, 1, 0)
    assert a.age == pytest.approx(40 + 11 / 365)   # 40 whole years + 11 days of a 365-day year
    assert (b.abo, b.rh, b.covid_result_binary, b.intubation_binary, b.died_binary) == ("O", "unknown", 0, 0, 1)
