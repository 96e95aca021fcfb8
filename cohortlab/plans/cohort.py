"""Cohort building on the clinical table roles.

Inputs are DataFrames with the column names of the clinical source tables (``concept_ancestor``,
``measurement``, ``labs``, ``admission`` …). Two versions of the analysis tables exist: ``*_v1`` (wide,
one snapshot date) and ``*_v2`` (time-to-event, everything up to an outcome date).

Risk factors are declarative: a rule table with one row per (factor, source, code/ancestor, threshold,
date floor) is joined ONCE to each source table (broadcast behind a size check), instead of one scan
of the event table per rule.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..session import cut_lineage
from ..operators import relational as rel
from ..operators.agg import consensus

# ---------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's definitions (vocabulary ids, codes, text rules, thresholds)
# ---------------------------------------------------------------------------------------------------
BLOOD_TYPE_ANCESTOR = 40776356
ABO_PATTERNS_V1 = [("AB%", "AB"), ("B%", "B"), ("O%", "O"), ("A%", "A")]
ABO_PATTERNS_V2 = [("AB %", "AB"), ("B %", "B"), ("O %", "O"), ("A %", "A")]
RH_PATTERNS_V1 = [(["%Pos%", "%+%", "%pos%"], "pos"), (["%Neg%", "%-%", "%neg%"], "neg")]
RH_PATTERNS_V2 = [(["%Pos%", "%+%"], "pos"), (["%Neg%", "%-%"], "neg")]
INVALID_LAB_V1 = ["Invalid", "Indeterminate", "Nasopharyngeal", "Not Given", "Void", "See Comment", "Yes"]
INVALID_LAB_V2 = ["Invalid", "Indeterminate", "(null)", "error", "ERROR", "Nasopharyngeal", "See Comment",
                  "Not Given", "Void", "CANCELED"]
TEST_RESULT_V2 = [("like", "Detected%", "Test: positive"), ("eq", "yes", "Test: positive"),
                  ("like", "Not detected%", "Test: negative"), ("eq", "sars-cov-2 neg", "Test: negative"),
                  ("eq", "positive", "Test: positive"), ("eq", "negative", "Test: negative")]
MAPPED_RELATIONSHIPS = ["Included in map from", "Mapped from"]
MAPPED_VOCABULARY = "ICD10CM"
ETHNICITY_V1 = [
    ("HISPANIC OR LATINO OR SPANISH ORIGIN", "hs"), ("NOT HISPANIC OR LATINO OR SPANISH ORIGIN", "nonhs"),
    ("MULTI-RACIAL", "other"), ("AFRICAN AMERICAN", "other"), ("CAUCASIAN", "other"),
    ("ASIAN / PACIFIC ISLANDER", "other"), ("AMERICAN INDIAN / ESKIMO", "other"),
    ("(null)", "missing"), ("DECLINED", "missing"), ("UNKNOWN", "missing")]
RACE_V1 = [
    ("WHITE", "white"), ("BLACK OR AFRICAN AMERICAN", "black_aa"), ("ASIAN", "asian"),
    ("OTHER COMBINATIONS NOT DESCRIBED", "other"), ("NAT.HAWAIIAN/OTH.PACIFIC ISLAND", "other"),
    ("AMERICAN INDIAN OR ALASKA NATION", "other"), ("ASHKENAZI JEWISH", "other"), ("SEPHARDIC JEWISH", "other"),
    ("DECLINED", "missing"), ("(null)", "missing")]
RACE_V2_MISSING = ["(null)", "DECLINED"]
RACE_V2 = [(["WHITE"], "white"), (["BLACK OR AFRICAN AMERICAN"], "black"),
           (["ASIAN", "NAT.HAWAIIAN/OTH.PACIFIC "], "asian")]
HISPANIC_V2 = "HISPANIC OR LATINO OR SPANISH ORIGIN"
DNR_DESCRIPTION = "DNR/DNI-DO NOT RESUSCITATE/DO NOT INTUBATE"
INTUBATION_SINCE_V1 = "2020-03-01"
ENTRY_LAG_HOURS = 96
CENSOR_HORIZON_DAYS = 10
# risk-factor rules (factor, source, key, threshold, since): the reference's five definitions
RISK_FACTOR_RULES = [
    ("cardiovascular_disorders", "icd_mapped", "134057", None, None),
    ("cardiovascular_disorders", "condition", "134057", None, None),
    ("diabetes_mellitus", "condition", "201820", None, None),
    ("diabetes_mellitus", "icd_prefix", "E08%", None, None),
    ("diabetes_mellitus", "icd_prefix", "E09%", None, None),
    ("diabetes_mellitus", "icd_prefix", "E10%", None, None),
    ("diabetes_mellitus", "icd_prefix", "E11%", None, None),
    ("diabetes_mellitus", "icd_prefix", "E13%", None, None),
    ("diabetes_mellitus", "measurement_text", "3004410", 6.5, None),
    ("diabetes_mellitus", "measurement_text", "3005673", 6.5, None),
    ("diabetes_mellitus", "measurement_text", "40758583", 6.5, None),
    ("diabetes_mellitus", "hospital_lab_text", "4548", 6.5, None),
    ("diabetes_mellitus", "hospital_lab_text", "17856", 6.5, None),
    ("hypertension", "icd_mapped", "316866", None, None),
    ("hypertension", "condition", "316866", None, None),
    ("obesity", "vitals_bmi", "bmi", 30.0, None),
    ("obesity", "measurement_value", "3038553", 30.0, "2019-01-01"),
    ("obesity", "observation", "4215968", None, None),
    ("obesity", "measurement_value", "40762636", 95.0, "2019-01-01"),
    ("respiratory_disorders", "icd_mapped", "320136", None, None),
    ("respiratory_disorders", "condition", "320136", None, None),
]
RISK_FACTORS = ["cardiovascular_disorders", "diabetes_mellitus", "hypertension", "obesity", "respiratory_disorders"]


def rule_table(spark: SparkSession, rules=RISK_FACTOR_RULES) -> DataFrame:
    return spark.createDataFrame(rules, "factor string, source string, key string, threshold double, since string")


# ---------------------------------------------------------------------------------------------------
# J1-J3 blood types
# ---------------------------------------------------------------------------------------------------

def parse_type(df: DataFrame, text: str = "abo_rh", version: int = 1, case_insensitive: bool = False) -> DataFrame:
    """Ordered LIKE recodes; v1 accepts 'A+' (no space), v2 requires 'A <rh>' (Q3)."""
    abo_p = ABO_PATTERNS_V1 if version == 1 else ABO_PATTERNS_V2
    rh_p = RH_PATTERNS_V1 if version == 1 else RH_PATTERNS_V2
    t = F.col(text)

    def rc(pats):
        out = None
        for p, v in pats:
            cond = X.like_any(t, p if isinstance(p, list) else [p], case_insensitive)
            out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
        return out
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, rc(abo_p).alias("abo"), rc(rh_p).alias("rh"))


def blood_type_measurements(concept_ancestor: DataFrame, measurement: DataFrame, patient2person: DataFrame,
                            concept: DataFrame, hospital_measurements: DataFrame, date_filter: Column,
                            person_id_as_mrn: bool = False, distinct_union: bool = False) -> DataFrame:
    """(pat_mrn_id, abo_rh) from the OMOP closure branch and the check-digit LOINC branch.

    ``date_filter`` applies to the hospital branch (``date_retrieved = d`` in v1, ``<= d`` in v2).
    """
    m = rel.descendants(measurement.select("person_id", "measurement_concept_id", "value_source_value"),
                        "measurement_concept_id", concept_ancestor, [BLOOD_TYPE_ANCESTOR])
    if person_id_as_mrn:
        b1 = m.select(F.col("person_id").alias("pat_mrn_id"), F.col("value_source_value").alias("abo_rh"))
    else:
        b1 = m.join(patient2person, "person_id").select("pat_mrn_id", F.col("value_source_value").alias("abo_rh"))
    codes = concept_ancestor.filter(F.col("ancestor_concept_id") == BLOOD_TYPE_ANCESTOR) \
        .join(concept, F.col("descendant_concept_id") == F.col("concept_id")) \
        .select(X.drop_check_digit("concept_code").alias("__loinc")).filter(F.col("__loinc").isNotNull())
    h = hospital_measurements.filter(date_filter)
    b2 = h.join(rel.checked_broadcast(codes), h["component_loinc_code"] == codes["__loinc"]) \
        .select("pat_mrn_id", F.col("ord_value").alias("abo_rh"))
    if not distinct_union:
        b1, b2 = b1.distinct(), b2.distinct()
    u = b1.unionByName(b2)
    u = u.distinct() if distinct_union else u
    return u.filter(F.col("abo_rh") != "Invalid")


def blood_groups_v1(t: Mapping[str, DataFrame], date: str) -> DataFrame:
    """S1 cache: distinct (pat_mrn_id, abo, rh)."""
    m = blood_type_measurements(t["concept_ancestor"], t["measurement"], t["patient2person"], t["concept"],
                                t["measurements"], F.col("date_retrieved") == F.lit(date).cast("date"))
    return parse_type(m, version=1).distinct()


def consistent_v1(groups: DataFrame) -> DataFrame:
    """J3 v1: ``COUNT(DISTINCT abo, rh) = 1`` (Q4/Q5: a NULL rh row stays alongside)."""
    return rel.keep_consistent(groups, "pat_mrn_id", ["abo", "rh"], "distinct_non_null")


def abo_types_v2(t: Mapping[str, DataFrame], outcome_date: str) -> DataFrame:
    """S2 ``abo_cleaned_types``: union distinct, v2 parse, persons with more than one row removed."""
    m = blood_type_measurements(t["concept_ancestor"], t["measurement"], t["patient2person"], t["concept"],
                                t["measurements"], F.col("date_retrieved") <= F.lit(outcome_date).cast("date"),
                                distinct_union=True)
    types = parse_type(m, version=2).distinct()
    return rel.keep_consistent(types, "pat_mrn_id", ["abo", "rh"], "single_row")


# ---------------------------------------------------------------------------------------------------
# J4-J9 risk factors (declarative rules, one join per source)
# ---------------------------------------------------------------------------------------------------

def risk_factors(t: Mapping[str, DataFrame], date: str, rules: DataFrame | None = None) -> DataFrame:
    """Distinct (pat_mrn_id, risk_factor) from all rules; every source table is scanned once."""
    spark = t["persons"].sparkSession
    rules = rules if rules is not None else rule_table(spark)
    ca, p2p = t["concept_ancestor"], t["patient2person"]
    day = F.lit(date).cast("date")
    out = []
    # Closure over condition_occurrence / observation (OMOP side), all ancestors of a table in one join
    for source, table_name, code_col in (("condition", "condition_occurrence", "condition_concept_id"),
                                         ("observation", "observation", "observation_concept_id")):
        r = rules.filter(F.col("source") == source).select("factor", F.col("key").cast("long").alias("ancestor_concept_id"))
        sub = ca.join(F.broadcast(r), "ancestor_concept_id").select("descendant_concept_id", "factor")
        ev = t[table_name].join(rel.checked_broadcast(sub), F.col(code_col) == F.col("descendant_concept_id"))
        out.append(ev.join(p2p, "person_id").select("pat_mrn_id", F.col("factor").alias("risk_factor")))
    # J4/C13 + J5 on hospital diagnoses in ONE scan: each row offers candidate keys — its cleaned code
    # (closure -> relationship -> ICD10CM code list) and its prefixes of every length used by prefix rules —
    # equi-joined to one (kind, key, factor) rule list
    r = rules.filter(F.col("source") == "icd_mapped").select("factor", F.col("key").cast("long").alias("ancestor_concept_id"))
    mapped = rel.mapped_codes(ca.join(F.broadcast(r), "ancestor_concept_id"), t["concept_relationship"], t["concept"],
                              r.select("ancestor_concept_id"), MAPPED_RELATIONSHIPS, MAPPED_VOCABULARY) \
        .select(F.lit("code").alias("__kind"), F.col("concept_code").alias("__key"), "factor")
    prefix_rules = [(row.factor, row.key) for row in rules.filter(F.col("source") == "icd_prefix")
                    .select("factor", "key").collect()]  # configuration rows (bounded)
    simple = [(f, k[:-1]) for f, k in prefix_rules if k.endswith("%") and not any(ch in k[:-1] for ch in "%_")]
    other = [(f, k) for f, k in prefix_rules if (f, k[:-1]) not in simple]
    lengths = sorted({len(k) for _f, k in simple})
    keyed = mapped
    if simple:
        keyed = keyed.unionByName(spark.createDataFrame([(f"p{len(k)}", k, f) for f, k in simple],
                                                        "__kind string, __key string, factor string"))
    dx = t["patients"].filter(F.col("date_retrieved") == day)
    cands = [F.struct(F.lit("code").alias("k"), F.replace("icd10_code", F.lit(","), F.lit("")).alias("v"))] + \
            [F.struct(F.lit(f"p{n}").alias("k"), F.substring("icd10_code", 1, n).alias("v")) for n in lengths]
    dxk = dx.select("pat_mrn_id", "icd10_code", F.inline(F.array(*cands)))
    out.append(dxk.join(rel.checked_broadcast(keyed), (F.col("k") == F.col("__kind")) & (F.col("v") == F.col("__key")))
               .select("pat_mrn_id", F.col("factor").alias("risk_factor")))
    if other:  # general LIKE patterns (none in the reference's rules)
        pre = spark.createDataFrame(other, "factor string, pattern string")
        out.append(dx.join(F.broadcast(pre), F.expr("icd10_code LIKE pattern"))
                   .select("pat_mrn_id", F.col("factor").alias("risk_factor")))
    # J6 + J7 on OMOP measurement in ONE join: text results over a threshold, numeric values with a date floor
    mr = rules.filter(F.col("source").isin("measurement_text", "measurement_value")).select(
        "factor", "source", F.col("key").cast("long").alias("__cid"), "threshold", "since")
    mj = t["measurement"].join(F.broadcast(mr), F.col("measurement_concept_id") == F.col("__cid"))
    hit = F.when(F.col("source") == "measurement_text", X.lab_value("value_source_value") >= F.col("threshold")) \
        .otherwise((F.col("measurement_date") >= F.col("since").cast("date")) & (F.col("value_as_number") >= F.col("threshold")))
    out.append(mj.filter(hit).join(p2p, "person_id").select("pat_mrn_id", F.col("factor").alias("risk_factor")))
    ht = rules.filter(F.col("source") == "hospital_lab_text").select(
        "factor", F.col("key").cast("long").alias("__loinc"), "threshold")
    out.append(t["measurements"].filter(F.col("date_retrieved") == day)
               .join(F.broadcast(ht), F.col("component_loinc_code") == F.col("__loinc"))
               .filter(X.lab_value("ord_value") >= F.col("threshold"))
               .select("pat_mrn_id", F.col("factor").alias("risk_factor")))
    vb = rules.filter(F.col("source") == "vitals_bmi").select("factor", "threshold")
    out.append(t["vitals"].filter(F.col("date_retrieved") == day).crossJoin(F.broadcast(vb))
               .filter(F.col("bmi") >= F.col("threshold")).select("pat_mrn_id", F.col("factor").alias("risk_factor")))
    return rel.union_distinct(out)


def risk_factor_flags(rf: DataFrame, factors: Sequence[str] = RISK_FACTORS) -> DataFrame:
    """One row per person, one 0/1 column per factor (pivot with declared levels)."""
    w = rf.groupBy("pat_mrn_id").pivot("risk_factor", list(factors)).agg(F.count(F.lit(1)))
    return w.select("pat_mrn_id", *[F.col(f).cast("int").alias(f"risk_factor_{f}") for f in factors])


# ---------------------------------------------------------------------------------------------------
# J10-J11, J20, J22 wide table v1
# ---------------------------------------------------------------------------------------------------

def test_results_v1(labs: DataFrame, date: str) -> DataFrame:
    """J10/J11 v1: ever 'Detected%' among valid results of the snapshot."""
    l = labs.filter((F.col("date_retrieved") == F.lit(date).cast("date")) & ~F.col("ord_value").isin(INVALID_LAB_V1))
    return l.groupBy("pat_mrn_id").agg(F.max(F.col("ord_value").like("Detected%")).alias("cov_pos"))


def demographics_v1(persons: DataFrame, date: str) -> DataFrame:
    """J20 v1: male_sex, age (days/365 at death or snapshot date), ethnicity, race (CASE without ELSE)."""
    death = X.zero_date("death_date")
    return persons.select(
        "pat_mrn_id", "sex_desc",
        F.when(F.col("sex_desc") == "Male", 1.0).otherwise(0.0).alias("male_sex"),
        (F.datediff(F.coalesce(death, F.lit(date).cast("date")), F.to_date("birth_date")) / 365.0).alias("age"),
        X.recode("ethnicity", ETHNICITY_V1).alias("ethnicity"),
        X.recode("race_1", RACE_V1).alias("race"),
        death.isNotNull().alias("died"))


def build_wide_v1(t: Mapping[str, DataFrame], date: str, version_hash: str) -> DataFrame:
    """Persons x tests x consistent types (inner) x intubation x risk flags (left), adults only."""
    groups = blood_groups_v1(t, date)
    cons = consistent_v1(groups)
    intub = t["intubation_orders"].filter((F.col("order_date") >= F.lit(INTUBATION_SINCE_V1).cast("timestamp")) &
                                          (F.col("date_retrieved") == F.lit(date).cast("date"))) \
        .select("pat_mrn_id").distinct().withColumn("intubated", F.lit(True))
    flags = risk_factor_flags(risk_factors(t, date))
    demo = demographics_v1(t["persons"], date)
    out = rel.assemble(demo, "pat_mrn_id", inner=[test_results_v1(t["labs"], date), cons], left=[intub, flags])
    out = out.filter(F.col("sex_desc").isin("Male", "Female") & F.col("pat_mrn_id").isNotNull() &
                     (F.col("pat_mrn_id") > 0) & (F.col("age") >= 18))
    return out.select(
        "pat_mrn_id", F.col("male_sex").cast("int").alias("male_sex"), F.col("age").cast("float").alias("age"),
        "ethnicity", "race", "abo", "rh",
        *[F.coalesce(F.col(f"risk_factor_{f}"), F.lit(0)).cast("boolean").alias(f"risk_factor_{f}") for f in RISK_FACTORS],
        "cov_pos", F.coalesce("intubated", F.lit(False)).alias("intubated"), "died",
        F.lit(date).cast("date").alias("date_retrieved"), F.lit(version_hash).alias("version_hash"))


def general_population_v1(t: Mapping[str, DataFrame], date: str) -> DataFrame:
    """J24/J25 v1: never-tested persons with a typed measurement, COUNT(DISTINCT person) by (abo, rh)."""
    m = rel.descendants(t["measurement"], "measurement_concept_id", t["concept_ancestor"], [BLOOD_TYPE_ANCESTOR])
    m = m.filter(F.col("value_source_value") != "Invalid").select("person_id", F.col("value_source_value").alias("abo_rh"))
    typed = parse_type(m, version=1).distinct().filter(F.col("rh").isin("pos", "neg"))
    tested = t["labs"].filter(F.col("date_retrieved") == F.lit(date).cast("date")).join(t["patient2person"], "pat_mrn_id") \
        .select("person_id")
    return rel.anti(typed, tested, "person_id").groupBy("abo", "rh").agg(
        F.count_distinct("person_id").alias("n")).withColumn("date_retrieved", F.lit(date).cast("date"))


# ---------------------------------------------------------------------------------------------------
# J10-J19, J21, J23-J25 time-to-event v2
# ---------------------------------------------------------------------------------------------------

def cleaned_tests_v2(labs: DataFrame, persons: DataFrame, outcome_date: str) -> DataFrame:
    """J10 v2: classify results, drop invalid ones and the automated-lab stand-in persons."""
    desc = None
    for kind, pat, val in TEST_RESULT_V2:
        cond = F.col("ord_value").like(pat) if kind == "like" else (F.col("ord_value") == pat)
        desc = F.when(cond, F.lit(val)) if desc is None else desc.when(cond, F.lit(val))
    stand_in = persons.filter(F.col("pat_name").like("AUTOMATEDLAB%")).select("pat_mrn_id")
    l = labs.filter(~F.col("ord_value").isin(INVALID_LAB_V2) &
                    (F.col("date_retrieved") <= F.lit(outcome_date).cast("date")))
    l = rel.anti(l, stand_in, "pat_mrn_id")
    return l.select("pat_mrn_id", F.col("result_datetime").alias("test_result_datetime"), desc.alias("event_desc"))


def race_consensus_v2(persons: DataFrame, cohort: DataFrame) -> DataFrame:
    """race_1..3 -> one scan unpivot, distinct, recode, consensus (NULL race falls to 'other', Q17)."""
    long = persons.select("pat_mrn_id", "race_1", "race_2", "race_3") \
        .unpivot(["pat_mrn_id"], ["race_1", "race_2", "race_3"], "__src", "race").select("pat_mrn_id", "race").distinct()
    long = rel.semi(long, cohort, "pat_mrn_id")
    r = F.col("race")
    cleaned = long.select("pat_mrn_id", F.when(r.isin(RACE_V2_MISSING), F.lit(None).cast("string"))
                          .when(r.isin(RACE_V2[0][0]), RACE_V2[0][1]).when(r.isin(RACE_V2[1][0]), RACE_V2[1][1])
                          .when(r.isin(RACE_V2[2][0]), RACE_V2[2][1]).otherwise("other").alias("race"))
    return consensus(cleaned, "pat_mrn_id", "race")


def build_basic_v2(t: Mapping[str, DataFrame], outcome_date: str, as_of: str) -> dict[str, DataFrame]:
    """Returns {'basic': one row per cohort person, 'tests': cleaned tests}."""
    types = abo_types_v2(t, outcome_date)
    tests = cleaned_tests_v2(t["labs"], t["persons"], outcome_date)
    persons = t["persons"]
    cohort = types.select("pat_mrn_id").join(tests.select("pat_mrn_id"), "pat_mrn_id") \
        .join(persons.select("pat_mrn_id"), "pat_mrn_id").distinct()
    fp = rel.semi(tests.filter(F.col("event_desc") == "Test: positive"), cohort, "pat_mrn_id") \
        .groupBy("pat_mrn_id").agg(F.min("test_result_datetime").alias("test_result_datetime"))
    adm = t["admission"]
    entry = cut_lineage(rel.entry_time(fp, adm, "pat_mrn_id", "test_result_datetime", "hosp_admsn_time", ENTRY_LAG_HOURS))
    mc = rel.max_censor(entry, adm, "pat_mrn_id", "cohort_entry_time", "hosp_admsn_time", "hosp_disch_time",
                        CENSOR_HORIZON_DAYS)
    cmm = cut_lineage(entry.join(mc, "pat_mrn_id"))     # used three times below
    dnr = rel.semi(t["orders"].filter(F.col("description") == DNR_DESCRIPTION), cohort, "pat_mrn_id") \
        .groupBy("pat_mrn_id").agg(F.min("order_date").alias("dnr_date"))
    io_ = t["intubation_orders"]
    # Q16: the LEFT JOIN followed by WHERE on right-side columns is an inner join
    intub = cmm.join(io_, "pat_mrn_id").filter(
        (F.col("order_status").isNull() | (F.col("order_status") != "Canceled")) &
        (F.col("order_date") >= F.col("cohort_entry_time")) & (F.col("order_date") <= F.col("max_censor_time")) &
        (F.col("date_retrieved") <= F.lit(outcome_date).cast("date"))) \
        .groupBy("pat_mrn_id").agg(F.min("order_date").alias("intubation_date")).withColumn("intubated", F.lit(1.0))
    deaths = cmm.join(t["birth_death"], "pat_mrn_id").filter(F.col("death_date") <= F.col("max_censor_time")) \
        .select("pat_mrn_id", "death_date", F.lit(1.0).alias("died"))
    outc = cmm.join(intub, "pat_mrn_id", "left").join(deaths, "pat_mrn_id", "left").select(
        "pat_mrn_id", "cohort_entry_time", "death_date",
        F.coalesce("intubation_date", "max_censor_time").alias("intubation_censor_time"),
        F.coalesce("intubated", F.lit(0.0)).alias("intubated"),
        F.coalesce("death_date", "max_censor_time").alias("death_censor_time"),
        F.coalesce("died", F.lit(0.0)).alias("died"))
    race = race_consensus_v2(persons, cohort)
    # persons' own text death_date is not used here: age uses the outcome table's death date
    person_cols = persons.select("pat_mrn_id", "birth_date", "sex_desc", "ethnicity")
    basic = cohort.join(person_cols, "pat_mrn_id").join(race, "pat_mrn_id").join(types, "pat_mrn_id") \
        .join(outc, "pat_mrn_id", "left").join(dnr, "pat_mrn_id", "left")
    basic = basic.filter(X.consistent_times("intubation_censor_time", "cohort_entry_time") &
                         X.consistent_times("death_censor_time", "cohort_entry_time"))
    age_end = F.coalesce(F.to_date("death_date"), F.lit(as_of).cast("date"))
    basic = basic.select(
        "pat_mrn_id", (F.datediff(age_end, F.to_date("birth_date")) / 365.0).alias("age"),
        F.when(F.col("sex_desc") == "Male", 1.0).otherwise(0.0).alias("male"), "race",
        F.when(F.col("ethnicity") == HISPANIC_V2, 1.0).otherwise(0.0).alias("hispanic"), "abo", "rh",
        "cohort_entry_time", "intubation_censor_time", "intubated", "dnr_date", "death_censor_time", "died")
    return {"basic": basic, "tests": tests}


def general_population_v2(t: Mapping[str, DataFrame], outcome_date: str) -> DataFrame:
    """J24/J25 v2: typed never-tested persons (two id spaces unioned as in the source, Q19), frequency of
    each ABO and Rh value with contradictory persons removed."""
    ca = t["concept_ancestor"]
    tested_person = t["labs"].join(t["patient2person"], "pat_mrn_id").select("person_id")
    m = rel.descendants(t["measurement"], "measurement_concept_id", ca, [BLOOD_TYPE_ANCESTOR])
    b1 = rel.anti(m, tested_person, "person_id").select(F.col("person_id").alias("pat_mrn_id"),
                                                         F.col("value_source_value").alias("abo_rh"))
    codes = ca.filter(F.col("ancestor_concept_id") == BLOOD_TYPE_ANCESTOR) \
        .join(t["concept"], F.col("descendant_concept_id") == F.col("concept_id")) \
        .select(X.drop_check_digit("concept_code").alias("__loinc")).filter(F.col("__loinc").isNotNull())
    h = t["measurements"].filter(F.col("date_retrieved") <= F.lit(outcome_date).cast("date"))
    b2 = rel.anti(h.join(F.broadcast(codes), F.col("component_loinc_code") == F.col("__loinc")),
                  t["labs"].select("pat_mrn_id"), "pat_mrn_id").select("pat_mrn_id", F.col("ord_value").alias("abo_rh"))
    gp = parse_type(b1.unionByName(b2).distinct().filter(F.col("abo_rh") != "Invalid"), version=2).distinct()
    bad = gp.groupBy("pat_mrn_id").count().filter("count > 1").select("pat_mrn_id")
    long = gp.select("pat_mrn_id", F.col("abo").alias("blood_type")).unionByName(
        gp.select("pat_mrn_id", F.col("rh").alias("blood_type")))
    long = rel.anti(long.filter(F.col("blood_type").isNotNull()), bad, "pat_mrn_id")
    return long.groupBy("blood_type").agg(F.count_distinct("pat_mrn_id").alias("N"))


# ---------------------------------------------------------------------------------------------------
# J26-J29 analysis-side records
# ---------------------------------------------------------------------------------------------------

def _max_na(c: Column, na_rm: bool) -> Column:
    """R ``max()``: NA when any value is NA (unless ``na_rm``); Spark's max skips NULLs."""
    return F.max(c) if na_rm else F.when(F.count_if(c.isNull()) > 0, F.lit(None)).otherwise(F.max(c))


def prevalence_v2(tests: DataFrame, hours: float = 96.0, na_rm: bool = False) -> DataFrame:
    """Ever positive, and positive within ``hours`` of the first recorded test.

    An unclassified result (NULL ``event_desc``, Q25) makes ``positive`` NA; as in R, the per-person max is
    then NA, and ``NA & (h <= hours)`` is NA inside the window but FALSE outside it.
    """
    first = tests.groupBy("pat_mrn_id").agg(F.min("test_result_datetime").alias("__first"))
    j = tests.join(first, "pat_mrn_id")
    pos = (F.col("event_desc") == "Test: positive").cast("double")
    within = X.hours_between("test_result_datetime", "__first") <= hours
    initial = F.when(~within, F.lit(0.0)).otherwise(pos)
    return j.groupBy("pat_mrn_id").agg(_max_na(pos, na_rm).alias("cov_pos"),
                                       _max_na(initial, na_rm).alias("initial_cov_pos"))


def competing_risk_v2(basic: DataFrame, kind: str, latest: str = "2020-08-01",
                      entry_limit: str = "2020-07-31") -> DataFrame:
    """J27 (kind='intubation': death competes) / J28 (kind='death': recovery competes).

    status: 0 censor, 1 event of interest, 2 first competing, 3 second competing; times in days.
    """
    lt = F.lit(latest).cast("timestamp")
    b = basic.filter(F.col("intubated" if kind == "intubation" else "died").isNotNull() &
                     (F.col("cohort_entry_time") <= F.lit(entry_limit).cast("timestamp")))
    if kind == "intubation":
        censor = X.pmin_na("intubation_censor_time", "death_censor_time", lt)
        outcome = F.when(X.pmin_na("intubation_censor_time", "death_censor_time") > lt, "censor") \
            .when(F.col("intubation_censor_time") < F.col("death_censor_time"), "intubation") \
            .when(F.col("died") == 1.0, "death") \
            .when((F.col("died") == 0) & (F.col("intubated") == 0), "recovery")
        status = {"censor": 0, "intubation": 1, "death": 2, "recovery": 3}
    else:
        censor = X.pmin_na("death_censor_time", lt)
        outcome = F.when(F.col("death_censor_time") > lt, "censor").when(F.col("died") == 1.0, "death") \
            .otherwise("recovery")
        status = {"censor": 0, "death": 1, "recovery": 2}
    r = b.withColumn("censor_time", censor).withColumn("outcome", outcome) \
        .withColumn("survival_time", X.days_between("censor_time", "cohort_entry_time"))
    keep = F.col("cohort_entry_time") <= F.col("censor_time")
    if kind == "intubation":
        keep = keep & (F.col("dnr_date").isNull() | (F.col("dnr_date") > F.col("censor_time")))
    return r.filter(keep).withColumn("status", X.map_recode("outcome", status))


#: result-comment code selecting the tests used in the first analysis (fixed value of the reference)
INITIAL_TEST_COMMENT_ID = 36072


def build_initial(tests: DataFrame, blood_types: DataFrame, intubation: DataFrame, date: str,
                  comment_id: int = INITIAL_TEST_COMMENT_ID) -> DataFrame:
    """First-version person table (R pipeline semantics).

    tests: pat_mrn_id, sex, birth_date, death_date (text), ord_value, comment_id;
    blood_types: pat_mrn_id, blood_type_value; intubation: pat_mrn_id, order_date, description, display_name.
    Persons with more than one distinct (abo, rh) tuple (NA tuples counted, as ``n_distinct``) are removed;
    positivity is summed per (person, sex, age, abo, rh, intubation, death) with NA propagating; missing
    ABO/Rh become 'unknown'.
    """
    t = tests.filter(F.col("comment_id") == comment_id).select(
        "pat_mrn_id", "sex", "birth_date", "death_date", F.col("ord_value").alias("covid_result"))
    bt = blood_types.select("pat_mrn_id", X.extract_or_null("blood_type_value", "^[ABO]+").alias("abo"),
                            X.extract_or_null(F.lower("blood_type_value"), "pos|neg").alias("rh"))
    multiple = bt.groupBy("pat_mrn_id").agg(F.count_distinct(F.struct("abo", "rh")).alias("__n")) \
        .filter(F.col("__n") > 1).select("pat_mrn_id")
    io_ = intubation.select("pat_mrn_id", F.col("order_date").alias("__od"), F.col("description").alias("__ds"),
                            F.col("display_name").alias("__dn"))
    full = rel.anti(t.join(bt, "pat_mrn_id", "left").join(io_, "pat_mrn_id", "left"), multiple, "pat_mrn_id")
    rows = full.select(
        "pat_mrn_id", "sex", X.interval_years("birth_date", F.lit(date)).alias("age"), "abo", "rh",
        (F.col("covid_result") == "Detected").cast("int").alias("covid_result_binary"),
        (F.col("__ds").isNotNull() & F.col("__od").isNotNull() & F.col("__dn").isNotNull()).cast("int")
        .alias("intubation_binary"),
        (F.col("death_date") != "0000-00-00").cast("int").alias("died_binary")).distinct()
    c = F.col("covid_result_binary")
    g = rows.groupBy("pat_mrn_id", "sex", "age", "abo", "rh", "intubation_binary", "died_binary").agg(
        F.when(F.count_if(c.isNull()) > 0, F.lit(None)).otherwise(F.sum(c)).cast("long").alias("covid_result_binary"))
    return g.filter(F.col("pat_mrn_id") != 0).fillna("unknown", subset=["abo", "rh"])
