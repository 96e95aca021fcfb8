import datetime as dt

import pytest

from cohortlab.plans import cohort as C
from cohortlab.operators import relational as rel

D = "2020-04-12"
DD = dt.date(2020, 4, 12)
OLD = dt.date(2020, 4, 1)


@pytest.fixture(scope="module")
def t(spark):
    mk = spark.createDataFrame
    ca = mk([(40776356, 1001), (40776356, 1002), (40776356, 1003), (134057, 2001), (201820, 2002),
             (316866, 2003), (320136, 2004), (4215968, 2005)], "ancestor_concept_id long, descendant_concept_id long")
    concept = mk([(1002, "882-1", "LOINC"), (1003, "LP12-3", "LOINC"), (3001, "I10", "ICD10CM"),
                  (3002, "J45", "ICD10CM"), (3003, "Z99", "ICD10CM")],
                 "concept_id long, concept_code string, vocabulary_id string")
    crel = mk([(2003, 3001, "Mapped from"), (2004, 3002, "Included in map from"), (2001, 3003, "Other")],
              "concept_id_1 long, concept_id_2 long, relationship_id string")
    meas = mk([
        (11, 1001, "A Rh Positive", None, dt.date(2020, 1, 1)),
        (12, 1001, "AB Neg", None, dt.date(2020, 1, 1)),
        (13, 1001, "B Positive", None, dt.date(2020, 1, 1)),
        (13, 1001, "O Positive", None, dt.date(2020, 1, 1)),
        (14, 1001, "A Positive", None, dt.date(2020, 1, 1)),
        (14, 1001, "A", None, dt.date(2020, 1, 1)),
        (15, 1001, "Invalid", None, dt.date(2020, 1, 1)),
        (28, 1001, "A+", None, dt.date(2020, 1, 1)),
        (16, 3004410, "<6.5", None, dt.date(2020, 1, 1)),
        (17, 3004410, "7.1%", None, dt.date(2020, 1, 1)),
        (18, 3004410, "%", None, dt.date(2020, 1, 1)),
        (19, 3004410, "1.2.3", None, dt.date(2020, 1, 1)),
        (20, 3004410, "see note", None, dt.date(2020, 1, 1)),
        (21, 3038553, None, 31.0, dt.date(2019, 5, 1)),
        (22, 3038553, None, 31.0, dt.date(2018, 5, 1)),
    ], "person_id long, measurement_concept_id long, value_source_value string, value_as_number double, "
       "measurement_date date")
    p2p = mk([(i, i + 100) for i in range(10, 40)], "person_id long, pat_mrn_id long")
    hosp = mk([(123, 882, "O Negative", "abo", "p", DD), (124, 12, "A Pos", "abo", "p", DD),
               (125, 4548, "6.6", "a1c", "p", DD), (126, 882, "B+", "abo", "p", OLD)],
              "pat_mrn_id long, component_loinc_code long, ord_value string, component_name string, "
              "procedure_name string, date_retrieved date")
    patients = mk([(130, "I10", DD), (131, "E11.9", DD), (132, "J4,5", DD), (133, "E11", OLD)],
                  "pat_mrn_id long, icd10_code string, date_retrieved date")
    cond = mk([(11, 2001)], "person_id long, condition_concept_id long")
    obs = mk([(12, 2005)], "person_id long, observation_concept_id long")
    vitals = mk([(127, 30.0, DD), (128, 29.9, DD)], "pat_mrn_id long, bmi double, date_retrieved date")
    persons = mk([(111, "x", "Male", dt.date(1950, 1, 1), "0000-00-00", "(null)", "WHITE", None, None),
                  (112, "y", "Female", dt.date(1990, 1, 1), "2020-04-01", "DECLINED", "ASIAN", None, None)],
                 "pat_mrn_id long, pat_name string, sex_desc string, birth_date date, death_date string, "
                 "ethnicity string, race_1 string, race_2 string, race_3 string")
    labs = mk([(111, "Detected", dt.datetime(2020, 4, 1), 1, DD), (112, "Not detected", dt.datetime(2020, 4, 1), 1, DD)],
              "pat_mrn_id long, ord_value string, result_datetime timestamp, comment_id long, date_retrieved date")
    io_ = mk([(111, dt.datetime(2020, 3, 5), "Done", "d", "n", DD)],
             "pat_mrn_id long, order_date timestamp, order_status string, description string, display_name string, "
             "date_retrieved date")
    return {"concept_ancestor": ca, "concept": concept, "concept_relationship": crel, "measurement": meas,
            "patient2person": p2p, "measurements": hosp, "patients": patients, "condition_occurrence": cond,
            "observation": obs, "vitals": vitals, "persons": persons, "labs": labs, "intubation_orders": io_}


def test_blood_groups_v1(t):
    rows = {(r.pat_mrn_id, r.abo, r.rh) for r in C.blood_groups_v1(t, D).collect()}
    assert (111, "A", "pos") in rows and (112, "AB", "neg") in rows
    assert (123, "O", "neg") in rows             # check-digit LOINC branch
    assert not any(r[0] == 124 for r in rows)    # code with letters never joins
    assert not any(r[0] == 126 for r in rows)    # other snapshot
    assert not any(r[0] == 115 for r in rows)    # 'Invalid'
    assert (128, "A", "pos") in rows             # v1 accepts 'A+' without a space (Q3)
    cons = {(r.pat_mrn_id, r.abo, r.rh) for r in C.consistent_v1(C.blood_groups_v1(t, D)).collect()}
    assert not any(r[0] == 113 for r in cons)    # contradictory
    assert {(114, "A", "pos"), (114, "A", None)} <= cons  # Q5: Rh-less row kept alongside


def test_parse_type_v2_requires_space(spark):
    df = spark.createDataFrame([("A+",), ("A Pos",), ("AB Neg",), ("o positive",)], "abo_rh string")
    got = [(r.abo, r.rh) for r in C.parse_type(df, version=2).collect()]
    assert got == [(None, "pos"), ("A", "pos"), ("AB", "neg"), (None, None)]
    ci = [(r.abo, r.rh) for r in C.parse_type(df, version=2, case_insensitive=True).collect()]
    assert ci[3] == ("O", "pos")


def test_risk_factors(t):
    rf = {(r.pat_mrn_id, r.risk_factor) for r in C.risk_factors(t, D).collect()}
    assert (111, "cardiovascular_disorders") in rf
    assert (112, "obesity") in rf                      # observation closure
    assert (116, "diabetes_mellitus") in rf            # '<6.5' counts as >= 6.5 (Q9)
    assert (117, "diabetes_mellitus") in rf            # '7.1%'
    for p in (118, 119, 120):                          # '%', '1.2.3', 'see note' -> no value (Q10)
        assert (p, "diabetes_mellitus") not in rf
    assert (121, "obesity") in rf and (122, "obesity") not in rf   # date floor
    assert (125, "diabetes_mellitus") in rf            # hospital lab text
    assert (127, "obesity") in rf and (128, "obesity") not in rf   # bmi >= 30
    assert (130, "hypertension") in rf                 # closure -> mapped ICD10CM
    assert (131, "diabetes_mellitus") in rf            # prefix E11%
    assert (132, "respiratory_disorders") in rf        # ',' removed before matching
    assert (133, "diabetes_mellitus") not in rf        # other snapshot


def test_wide_v1(t):
    w = {r.pat_mrn_id: r for r in C.build_wide_v1(t, D, "h" * 40).collect()}
    assert set(w) == {111, 112}
    a = w[111]
    assert a.cov_pos is True and a.intubated is True and a.died is False and a.male_sex == 1
    assert a.ethnicity == "missing" and a.race == "white" and a.risk_factor_cardiovascular_disorders is True
    b = w[112]
    assert b.cov_pos is False and b.died is True and b.intubated is False and b.risk_factor_obesity is True
    assert abs(b.age - (dt.date(2020, 4, 1) - dt.date(1990, 1, 1)).days / 365) < 1e-4


def test_entry_time_96h_boundary(spark):
    first = spark.createDataFrame([(1, dt.datetime(2020, 4, 5, 23)), (2, dt.datetime(2020, 4, 6, 0)),
                                   (3, dt.datetime(2020, 4, 6, 1))], "k long, t timestamp")
    adm = spark.createDataFrame([(k, dt.datetime(2020, 4, 2, 0)) for k in (1, 2, 3)], "k long, s timestamp")
    got = {r.k: r.cohort_entry_time for r in rel.entry_time(first, adm, "k", "t", "s", 96).collect()}
    assert got[1] == dt.datetime(2020, 4, 2) and got[2] == dt.datetime(2020, 4, 2)   # 95 h, exactly 96 h
    assert got[3] == dt.datetime(2020, 4, 6, 1)                                      # 97 h


def test_max_censor_spanning(spark):
    e = spark.createDataFrame([(1, dt.datetime(2020, 4, 1)), (2, dt.datetime(2020, 4, 1))], "k long, entry timestamp")
    iv = spark.createDataFrame([(1, dt.datetime(2020, 3, 30), dt.datetime(2020, 4, 20)),
                                (2, dt.datetime(2020, 3, 30), dt.datetime(2020, 4, 5))], "k long, s timestamp, e timestamp")
    got = {r.k: r.max_censor_time for r in rel.max_censor(e, iv, "k", "entry", "s", "e", 10).collect()}
    assert got[1] == dt.datetime(2020, 4, 20) and got[2] == dt.datetime(2020, 4, 11)


def test_competing_risk_records(spark):
    b = spark.createDataFrame([
        # intubated before death
        (1, dt.datetime(2020, 4, 1), dt.datetime(2020, 4, 3), 1.0, None, dt.datetime(2020, 4, 11), 0.0),
        # died, not intubated
        (2, dt.datetime(2020, 4, 1), dt.datetime(2020, 4, 11), 0.0, None, dt.datetime(2020, 4, 5), 1.0),
        # tie: intubation time == death time, not died -> NA outcome (Q24)
        (3, dt.datetime(2020, 4, 1), dt.datetime(2020, 4, 5), 1.0, None, dt.datetime(2020, 4, 5), 0.0),
        # DNR before censor -> excluded
        (4, dt.datetime(2020, 4, 1), dt.datetime(2020, 4, 11), 0.0, dt.datetime(2020, 4, 2), dt.datetime(2020, 4, 11), 0.0),
        # recovery
        (5, dt.datetime(2020, 4, 1), dt.datetime(2020, 4, 11), 0.0, dt.datetime(2020, 4, 20), dt.datetime(2020, 4, 11), 0.0),
    ], "pat_mrn_id long, cohort_entry_time timestamp, intubation_censor_time timestamp, intubated double, "
       "dnr_date timestamp, death_censor_time timestamp, died double")
    r = {x.pat_mrn_id: x for x in C.competing_risk_v2(b, "intubation").collect()}
    assert r[1].outcome == "intubation" and r[1].status == 1 and r[1].survival_time == pytest.approx(2.0)
    assert r[2].outcome == "death" and r[2].status == 2 and r[2].survival_time == pytest.approx(4.0)
    assert r[3].outcome is None
    assert 4 not in r
    assert r[5].outcome == "recovery" and r[5].status == 3
    d = {x.pat_mrn_id: x for x in C.competing_risk_v2(b, "death").collect()}
    assert d[2].outcome == "death" and d[1].outcome == "recovery"


def test_race_consensus_v2(spark):
    persons = spark.createDataFrame([(1, "WHITE", "WHITE", None), (2, "WHITE", "ASIAN", "(null)"),
                                     (3, "(null)", "DECLINED", "(null)"), (4, "BLACK OR AFRICAN AMERICAN", None, None)],
                                    "pat_mrn_id long, race_1 string, race_2 string, race_3 string")
    cohort = persons.select("pat_mrn_id")
    got = {r.pat_mrn_id: r.race for r in C.race_consensus_v2(persons, cohort).collect()}
    # NULL race falls to ELSE 'other' (Q17), so a person with a SQL NULL column has two values
    assert got == {1: "other", 2: "other", 3: "missing", 4: "other"}


def test_prevalence_na_semantics(spark):
    rows = [(1, dt.datetime(2020, 4, 1), "Test: negative"), (1, dt.datetime(2020, 4, 2), "Test: positive"),
            (2, dt.datetime(2020, 4, 1), "Test: positive"), (2, dt.datetime(2020, 4, 20), None),
            (3, dt.datetime(2020, 4, 1), None), (3, dt.datetime(2020, 4, 2), "Test: positive")]
    tests = spark.createDataFrame(rows, "pat_mrn_id long, test_result_datetime timestamp, event_desc string")
    got = {r.pat_mrn_id: (r.cov_pos, r.initial_cov_pos) for r in C.prevalence_v2(tests).collect()}
    assert got[1] == (1.0, 1.0)
    assert got[2] == (None, 1.0)   # NA outside the 96 h window is FALSE; max(1, NA) over all is NA
    assert got[3] == (None, None)  # NA inside the window propagates
    rm = {r.pat_mrn_id: (r.cov_pos, r.initial_cov_pos) for r in C.prevalence_v2(tests, na_rm=True).collect()}
    assert rm[3] == (1.0, 1.0)
