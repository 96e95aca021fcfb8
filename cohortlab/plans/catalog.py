"""Registered queries over the driver tables: Spark plan + DuckDB oracle SQL per operator family.

Each entry maps a name to ``(callable(spark, sf_dir) -> DataFrame, oracle_sql | None)``. Floating
results are rounded identically on both sides; oracle SQL is omitted where the value needs an odd-df
chi-squared / normal tail (no ``erfc`` in DuckDB), a seeded hash draw, or an iterative root.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X, fmt
from ..operators import agg as A
from ..operators import contingency as K
from ..operators import glm, meta, relational as rel, reshape as R, resample, survival, vectors
from ..session import cut_lineage, reread_partitions, scratch_path
from ..sources import io
from . import driver as D
from .driver import SEGMENTS, table, with_ctes

REGISTRY: dict[str, tuple] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _r(c, n=6):
    return F.round(c if not isinstance(c, str) else F.col(c), n)


# ====================================================================== sources / projections

@register("snapshot_order_status", """
SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total_price
FROM orders WHERE o_orderdate <= TIMESTAMP '1998-12-31 00:00:00' GROUP BY o_orderstatus""")
def snapshot_order_status(spark: SparkSession, d: str) -> DataFrame:
    """A1/A3: snapshot-up-to scan, pushed to the Parquet reader."""
    o = io.snapshot_upto(io.read_table(spark, d, "orders"), "1998-12-31", column="o_orderdate")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("o_totalprice"), 2).alias("total_price"))


# ====================================================================== cohort building (J*)

@register("parse_type", with_ctes(["typed"], "SELECT person, abo, rh FROM typed"))
def parse_type(spark, d):
    """Closure-selected measurements parsed into two categories."""
    return D.typed(spark, d)


@register("consistent_types", with_ctes(["consistent"], "SELECT person, abo, rh FROM consistent"))
def consistent_types(spark, d):
    """COUNT(DISTINCT abo, rh) = 1 policy."""
    return D.consistent_types(spark, d)


@register("single_row_types", with_ctes(["typed"], """
SELECT person, abo, rh FROM typed
WHERE person NOT IN (SELECT person FROM typed GROUP BY person HAVING COUNT(*) > 1)"""))
def single_row_types(spark, d):
    """J3 second policy: drop persons with more than one typed row (C9 anti join)."""
    return rel.keep_consistent(D.typed(spark, d), "person", ["abo", "rh"], "single_row")


@register("grouped_levels_typed", with_ctes(["consistent"], """
SELECT 'abo' AS family, abo AS "group", COUNT(*) AS n FROM consistent GROUP BY abo
UNION ALL SELECT 'rh', rh, COUNT(*) FROM consistent GROUP BY rh
UNION ALL SELECT 'abo_rh', abo || '-' || rh, COUNT(*) FROM consistent GROUP BY abo, rh
UNION ALL SELECT 'TOTAL', 'TOTAL', COUNT(*) FROM consistent"""))
def grouped_levels_typed(spark, d):
    """Family-wise and total counts in one grouping-sets pass."""
    return A.grouped_levels(D.consistent_types(spark, d), {"abo": ["abo"], "rh": ["rh"], "abo_rh": ["abo", "rh"]},
                            [F.count(F.lit(1)).alias("n")])


@register("test_results", with_ctes(["tests"], "SELECT person, cov_pos, n_tests FROM tests"))
def test_results(spark, d):
    """Invalid results dropped, ever-positive per person."""
    return D.test_results(spark, d)


@register("comparison_counts", with_ctes(["typed"], """
, gp AS (SELECT * FROM typed WHERE person NOT IN (SELECT user_id FROM events))
SELECT blood_type, COUNT(DISTINCT person) AS n FROM (
  SELECT person, abo AS blood_type FROM gp UNION ALL SELECT person, rh AS blood_type FROM gp) u
WHERE blood_type IS NOT NULL
  AND person NOT IN (SELECT person FROM gp GROUP BY person HAVING COUNT(*) > 1)
GROUP BY blood_type""").replace("\n, gp AS", ",\ngp AS"))
def comparison_counts(spark, d):
    """Typed persons never tested, marginal counts, contradictory persons removed."""
    users = table(spark, d, "events").select(F.col("user_id").alias("person"))
    gp = rel.anti(D.typed(spark, d), users, "person")
    bad = gp.groupBy("person").count().filter("count > 1").select("person")
    long = rel.union_all([gp.select("person", F.col("abo").alias("blood_type")),
                          gp.select("person", F.col("rh").alias("blood_type"))])
    long = rel.anti(long.filter(F.col("blood_type").isNotNull()), bad, "person")
    return long.groupBy("blood_type").agg(F.count_distinct("person").alias("n"))


RISK_SQL = """
rf AS (
  SELECT DISTINCT o_custkey AS person, 'cardio' AS factor FROM lineitem
    JOIN closure ON l_partkey = descendant JOIN orders ON l_orderkey = o_orderkey WHERE ancestor = 'PROMO'
  UNION ALL
  SELECT DISTINCT o_custkey, 'diabetes' FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN orders ON l_orderkey = o_orderkey WHERE p_brand LIKE 'Brand#21%' OR p_brand LIKE 'Brand#22%'
  UNION ALL
  SELECT DISTINCT user_id, 'lab' FROM events WHERE event_type = 'view'
    AND regexp_extract(props, '[0-9]+') || '%' SIMILAR TO '[<>%0-9.]+'
    AND TRY_CAST(replace(replace(replace(regexp_extract(props, '[0-9]+') || '%', '<', ''), '>', ''), '%', '') AS DECIMAL(10,5)) >= 90
  UNION ALL
  SELECT DISTINCT o_custkey, 'obesity' FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_quantity >= 45 AND l_shipdate >= TIMESTAMP '1998-01-01 00:00:00')"""


def risk_factors(spark, d) -> DataFrame:
    """Declarative rules with ONE scan per source table, unioned distinct (person, factor).

    lineitem: the code rules (closure descendants of 'PROMO', brands LIKE 'Brand#21%'/'Brand#22%') form one
    small (code, factor) list joined once (size-checked broadcast); the value rule (quantity with a date
    floor) is evaluated in the same scan; orders is joined once for the person key. events: text-lab rule.
    """
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    closure = D.part_closure(spark, d)
    codes = rel.union_all([
        closure.filter(F.col("ancestor") == "PROMO").select(F.col("descendant").alias("__code"),
                                                           F.lit("cardio").alias("__factor")),
        table(spark, d, "part").filter(X.like_any("p_brand", ["Brand#21%", "Brand#22%"]))
        .select(F.col("p_partkey").alias("__code"), F.lit("diabetes").alias("__factor")),
    ]).distinct()
    coded = li.join(rel.checked_broadcast(codes), F.col("l_partkey") == F.col("__code"), "left")
    value_rule = (F.col("l_quantity") >= 45) & (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    factors = F.array_compact(F.array(F.col("__factor"), F.when(value_rule, F.lit("obesity"))))
    hits = coded.select("l_orderkey", F.explode(factors).alias("factor"))
    from_items = hits.join(o, hits.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("person"), "factor")
    ev = table(spark, d, "events").filter(F.col("event_type") == "view")
    text = F.concat(F.regexp_extract("props", "[0-9]+", 0), F.lit("%"))
    lab = ev.filter(X.lab_value(text) >= 90).select(F.col("user_id").alias("person"), F.lit("lab").alias("factor"))
    return rel.union_distinct([from_items, lab])


@register("risk_factors_long", with_ctes(["closure"], "," + RISK_SQL + "\nSELECT DISTINCT person, factor FROM rf"))
def risk_factors_long(spark, d):
    """J8 (J4 closure, J5 prefix, J6 text-lab threshold, J7 value + date floor)."""
    return risk_factors(spark, d)


FACTORS = ["cardio", "diabetes", "lab", "obesity"]


@register("wide_table", with_ctes(["tested", "closure"], "," + RISK_SQL + """
, flags AS (SELECT person, """ + ", ".join(f"MAX(CASE WHEN factor = '{f}' THEN 1 ELSE 0 END) AS rf_{f}" for f in FACTORS)
                                   + """ FROM rf GROUP BY person)
SELECT t.person, c_mktsegment, t.abo, t.rh, t.cov_pos, COALESCE(t.intubated, 0) AS intubated,
       COALESCE(t.died, 0) AS died, """ + ", ".join(f"COALESCE(rf_{f}, 0) AS rf_{f}" for f in FACTORS) + """
FROM tested t JOIN customer ON t.person = c_custkey LEFT JOIN flags f ON t.person = f.person
WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') AND t.person >= 0"""))
def wide_table(spark, d):
    """Persons x tests x consistent types (inner) + outcomes + risk-factor flags (left, 0 default)."""
    flags = R.widen(risk_factors(spark, d).withColumn("one", F.lit(1)), ["person"], "factor", "one", FACTORS, agg="max")
    flags = flags.select("person", *[F.col(f).alias(f"rf_{f}") for f in FACTORS])
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), "c_mktsegment")
    base = rel.assemble(D.tested_persons(spark, d), "person", inner=[cust], left=[flags])
    base = base.filter(F.col("c_mktsegment").isin(SEGMENTS) & (F.col("person") >= 0))
    return base.select("person", "c_mktsegment", "abo", "rh", "cov_pos",
                       F.coalesce("intubated", F.lit(0)).alias("intubated"), F.coalesce("died", F.lit(0)).alias("died"),
                       *[F.coalesce(f"rf_{f}", F.lit(0)).alias(f"rf_{f}") for f in FACTORS])


NULL_SQL = with_ctes(["tested", "closure"], "," + RISK_SQL + """
, flags AS (SELECT person, """ + ", ".join(f"MAX(CASE WHEN factor = '{f}' THEN 1 ELSE 0 END) AS rf_{f}" for f in FACTORS)
                   + """ FROM rf GROUP BY person)
, w AS (SELECT t.person, c_mktsegment, t.abo, t.rh, t.cov_pos, COALESCE(t.intubated, 0) AS intubated,
       COALESCE(t.died, 0) AS died, """ + ", ".join(f"COALESCE(rf_{f}, 0) AS rf_{f}" for f in FACTORS) + """
FROM tested t JOIN customer ON t.person = c_custkey LEFT JOIN flags f ON t.person = f.person
WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') AND t.person >= 0)
""" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {c} IS NULL) AS n_null FROM w" for c in
                         ["person", "c_mktsegment", "abo", "rh", "cov_pos", "intubated", "died"] + [f"rf_{f}" for f in FACTORS]))


@register("null_counts_wide", NULL_SQL)
def null_counts_wide(spark, d):
    """NULL count of every column of the wide table in one pass."""
    return A.null_counts(wide_table(spark, d))


@register("race_consensus", """
WITH long AS (
  SELECT DISTINCT c_custkey AS person, race FROM (
    SELECT c_custkey, c_mktsegment AS race FROM customer
    UNION ALL SELECT c_custkey, CASE WHEN c_acctbal < 1000 THEN '(null)' ELSE c_mktsegment END FROM customer
    UNION ALL SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'BUILDING' ELSE c_mktsegment END FROM customer) u),
cleaned AS (SELECT person, CASE WHEN race IN ('(null)', 'DECLINED') THEN NULL WHEN race = 'AUTOMOBILE' THEN 'white'
  WHEN race = 'BUILDING' THEN 'black' WHEN race IN ('FURNITURE', 'HOUSEHOLD') THEN 'asian' ELSE 'other' END AS race FROM long)
SELECT person, CASE WHEN COUNT(DISTINCT race) = 1 THEN MAX(race) WHEN COUNT(DISTINCT race) = 0 THEN 'missing'
  ELSE 'other' END AS race FROM cleaned GROUP BY person""")
def race_consensus(spark, d):
    """Three columns unpivoted in one scan, distinct, recoded, consensus per person."""
    c = table(spark, d, "customer")
    wide = c.select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("race_1"),
                    F.when(F.col("c_acctbal") < 1000, F.lit("(null)")).otherwise(F.col("c_mktsegment")).alias("race_2"),
                    F.when(F.col("c_acctbal") > 9000, F.lit("BUILDING")).otherwise(F.col("c_mktsegment")).alias("race_3"))
    long = R.lengthen(wide, ["person"], ["race_1", "race_2", "race_3"], "src", "race").select("person", "race").distinct()
    cleaned = long.select("person", X.recode("race", [
        (F.col("race").isin("(null)", "DECLINED"), F.lit(None).cast("string")),
        (F.col("race") == "AUTOMOBILE", "white"), (F.col("race") == "BUILDING", "black"),
        (F.col("race").isin("FURNITURE", "HOUSEHOLD"), "asian")], default="other", kind="expr").alias("race"))
    return A.consensus(cleaned, "person", "race")


@register("demographics", """
SELECT c_custkey AS person,
  ROUND(datediff('day', CAST(MIN(o_orderdate) AS DATE), DATE '2002-01-01') / 365.0, 6) AS age,
  CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS male,
  CASE WHEN r_name = 'AFRICA' THEN 'hs' WHEN r_name IN ('AMERICA', 'ASIA') THEN 'nonhs'
       WHEN r_name = 'EUROPE' THEN 'other' END AS ethnicity
FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY c_custkey, c_mktsegment, r_name""")
def demographics(spark, d):
    """Age from a birth-like date (days/365), binary sex analogue, CASE without ELSE (Q18)."""
    c = table(spark, d, "customer")
    first = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("birth"))
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = c.join(first, c.c_custkey == first.o_custkey).join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey)
    return j.select(F.col("c_custkey").alias("person"),
                    _r(X.age_years("birth", F.lit("2002-01-01"))).alias("age"),
                    F.when(F.col("c_mktsegment") == "MACHINERY", 1.0).otherwise(0.0).alias("male"),
                    X.recode("r_name", [(F.col("r_name") == "AFRICA", "hs"),
                                        (F.col("r_name").isin("AMERICA", "ASIA"), "nonhs"),
                                        (F.col("r_name") == "EUROPE", "other")], kind="expr").alias("ethnicity"))


COHORT_SQL = """
, cohort AS (SELECT DISTINCT person FROM consistent JOIN tests USING (person))
, fp AS (SELECT user_id AS person, MIN(ts) AS t FROM events WHERE event_type = 'purchase' AND value >= 150.0
         AND user_id IN (SELECT person FROM cohort) GROUP BY user_id)
, enc AS (SELECT user_id AS person, ts AS adm, ts + INTERVAL 48 HOUR AS dis FROM events WHERE event_type = 'view')
, entry AS (SELECT fp.person, MIN(CASE WHEN fp.t >= enc.adm AND epoch_us(fp.t) - epoch_us(enc.adm) <= 345600000000
                                      THEN enc.adm ELSE fp.t END) AS cohort_entry_time
            FROM fp LEFT JOIN enc ON fp.person = enc.person GROUP BY fp.person)
, mc AS (SELECT e.person, MAX(CASE WHEN enc.adm <= e.cohort_entry_time + INTERVAL 10 DAY
                                   AND enc.dis > e.cohort_entry_time + INTERVAL 10 DAY
                                   THEN enc.dis ELSE e.cohort_entry_time + INTERVAL 10 DAY END) AS max_censor_time
         FROM entry e LEFT JOIN enc ON e.person = enc.person GROUP BY e.person)
, cmm AS (SELECT * FROM entry JOIN mc USING (person))
, intub AS (SELECT c.person, MIN(ts) AS intubation_date FROM cmm c JOIN events ev ON c.person = ev.user_id
            WHERE ev.event_type = 'signup' AND ev.value >= 150.0 AND ev.ts >= c.cohort_entry_time
              AND ev.ts <= c.max_censor_time GROUP BY c.person)
, death AS (SELECT user_id AS person, MIN(ts) AS death_date FROM events WHERE event_type = 'click' AND value >= 200.0
            GROUP BY user_id)
, deaths AS (SELECT c.person, d.death_date FROM cmm c JOIN death d ON c.person = d.person
             WHERE d.death_date <= c.max_censor_time)
, outcomes_t AS (SELECT c.person, c.cohort_entry_time, dd.death_date,
      COALESCE(i.intubation_date, c.max_censor_time) AS intubation_censor_time,
      CAST(CASE WHEN i.intubation_date IS NOT NULL THEN 1.0 ELSE 0.0 END AS DOUBLE) AS intubated,
      COALESCE(dd.death_date, c.max_censor_time) AS death_censor_time,
      CAST(CASE WHEN dd.death_date IS NOT NULL THEN 1.0 ELSE 0.0 END AS DOUBLE) AS died
    FROM cmm c LEFT JOIN intub i ON c.person = i.person LEFT JOIN deaths dd ON c.person = dd.person)
, dnr AS (SELECT user_id AS person, MIN(ts) AS dnr_date FROM events WHERE event_type = 'error'
          AND value >= 200.0 AND user_id IN (SELECT person FROM cohort) GROUP BY user_id)"""


def cohort_frames(spark, d, cons: DataFrame | None = None):
    """Cohort keys, entry, maximum censor, outcomes between bounds, exclusion order date."""
    ev = table(spark, d, "events")
    cons = cons if cons is not None else D.consistent_types(spark, d)
    cohort = cons.select("person").join(D.test_results(spark, d).select("person"), "person").distinct()
    # one aggregate over the events gives every per-person minimum; written once, so the steps below neither
    # scan the events again for them nor repeat each other's lineage
    order = ev.filter(F.col("event_type").isin("purchase", "click", "error")).groupBy(F.col("user_id").alias("person")).agg(
        F.min(F.when((F.col("event_type") == "purchase") & (F.col("value") >= D.POSITIVE_VALUE), F.col("ts"))).alias("t"),
        F.min(F.when((F.col("event_type") == "click") & (F.col("value") >= 200.0), F.col("ts"))).alias("death_date"),
        F.min(F.when((F.col("event_type") == "error") & (F.col("value") >= 200.0), F.col("ts"))).alias("dnr_date"))
    base = cut_lineage(cohort.join(order, "person", "left"))
    fp = base.filter("t is not null").select("person", "t")
    enc = ev.filter(F.col("event_type") == "view").select(
        F.col("user_id").alias("person"), F.col("ts").alias("adm"),
        (F.col("ts") + F.expr("INTERVAL 48 HOURS")).alias("dis"))
    entry = cut_lineage(rel.entry_time(fp, enc, "person", "t", "adm", 96.0))
    mc = rel.max_censor(entry, enc, "person", "cohort_entry_time", "adm", "dis", 10)
    cmm = cut_lineage(entry.join(mc, "person"))
    sign = ev.filter((F.col("event_type") == "signup") & (F.col("value") >= D.POSITIVE_VALUE)) \
        .select(F.col("user_id").alias("person"), "ts")
    intub = rel.events_between(cmm, sign, "person", "cohort_entry_time", "max_censor_time", "ts") \
        .groupBy("person").agg(F.min("ts").alias("intubation_date"))
    deaths = cmm.join(base.select("person", "death_date"), "person").filter(F.col("death_date") <= F.col("max_censor_time")).select("person", "death_date")
    out = cmm.join(intub, "person", "left").join(deaths, "person", "left").select(
        "person", "cohort_entry_time", "death_date",
        F.coalesce("intubation_date", "max_censor_time").alias("intubation_censor_time"),
        F.when(F.col("intubation_date").isNotNull(), 1.0).otherwise(0.0).alias("intubated"),
        F.coalesce("death_date", "max_censor_time").alias("death_censor_time"),
        F.when(F.col("death_date").isNotNull(), 1.0).otherwise(0.0).alias("died"))
    dnr = base.filter("dnr_date is not null").select("person", "dnr_date")
    return {"cohort": base.select("person"), "fp": fp, "entry": entry, "mc": mc, "cmm": cmm, "outcomes": out, "dnr": dnr}


@register("cohort_entry_censor", with_ctes(["consistent", "tests"], COHORT_SQL + """
SELECT fp.person, fp.t AS first_positive, cohort_entry_time, max_censor_time
FROM fp JOIN cmm ON fp.person = cmm.person"""))
def cohort_entry_censor(spark, d):
    """First positive, entry (96 h rule), maximum censor (10 days / spanning encounter)."""
    f = cohort_frames(spark, d)
    return f["fp"].withColumnRenamed("t", "first_positive").join(f["cmm"], "person")


@register("outcomes_between", with_ctes(["consistent", "tests"], COHORT_SQL + """
SELECT person, cohort_entry_time, death_date, intubation_censor_time, intubated, death_censor_time, died
FROM outcomes_t"""))
def outcomes_between(spark, d):
    """First event inside [entry, censor], death before censor, coalesced censor times."""
    return cohort_frames(spark, d)["outcomes"]


BASIC_SQL = """
, race_c AS (SELECT c_custkey AS person, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'white'
     WHEN c_mktsegment = 'BUILDING' THEN 'black' WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'asian'
     ELSE 'other' END AS race FROM customer)
, basic AS (SELECT k.person, ROUND(c_acctbal / 100.0, 6) AS age, CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS male,
     rc.race, CAST(CASE WHEN c_nationkey < 5 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS hispanic, ct.abo, ct.rh,
     o.cohort_entry_time, o.intubation_censor_time, o.intubated, dn.dnr_date, o.death_censor_time, o.died
   FROM cohort k JOIN customer ON k.person = c_custkey JOIN race_c rc ON k.person = rc.person
   JOIN consistent ct ON k.person = ct.person LEFT JOIN outcomes_t o ON k.person = o.person
   LEFT JOIN dnr dn ON k.person = dn.person
   WHERE (o.intubation_censor_time IS NULL OR o.intubation_censor_time >= o.cohort_entry_time)
     AND (o.death_censor_time IS NULL OR o.death_censor_time >= o.cohort_entry_time))"""


def basic_table(spark, d):
    """One row per cohort person with demographics, types and time-to-event columns (B13 filter)."""
    cons = D.consistent_types(spark, d)
    f = cohort_frames(spark, d, cons)
    c = table(spark, d, "customer")
    race = c.select(F.col("c_custkey").alias("person"), X.recode("c_mktsegment", [
        (F.col("c_mktsegment") == "AUTOMOBILE", "white"), (F.col("c_mktsegment") == "BUILDING", "black"),
        (F.col("c_mktsegment").isin("FURNITURE", "HOUSEHOLD"), "asian")], default="other", kind="expr").alias("race"))
    demo = c.select(F.col("c_custkey").alias("person"), _r(F.col("c_acctbal") / 100.0).alias("age"),
                    F.when(F.col("c_mktsegment") == "MACHINERY", 1.0).otherwise(0.0).alias("male"),
                    F.when(F.col("c_nationkey") < 5, 1.0).otherwise(0.0).alias("hispanic"))
    out = rel.assemble(f["cohort"], "person", inner=[demo, race, cons],
                       left=[f["outcomes"].drop("death_date"), f["dnr"]])
    out = out.filter(X.consistent_times("intubation_censor_time", "cohort_entry_time") &
                     X.consistent_times("death_censor_time", "cohort_entry_time"))
    return out.select("person", "age", "male", "race", "hispanic", "abo", "rh", "cohort_entry_time",
                      "intubation_censor_time", "intubated", "dnr_date", "death_censor_time", "died")


@register("basic_time_to_event", with_ctes(["consistent", "tests"], COHORT_SQL + BASIC_SQL + """
SELECT * FROM basic"""))
def basic_time_to_event(spark, d):
    return basic_table(spark, d)


LATEST = "2024-01-31 00:00:00"
ENTRY_LIMIT = "2024-01-28 00:00:00"

CR_SQL = f"""
, cr AS (SELECT person, abo, rh, race, hispanic, cohort_entry_time, dnr_date,
    CASE WHEN intubation_censor_time IS NULL OR death_censor_time IS NULL THEN NULL
         ELSE LEAST(intubation_censor_time, death_censor_time, TIMESTAMP '{LATEST}') END AS censor_time,
    CASE WHEN LEAST(intubation_censor_time, death_censor_time) > TIMESTAMP '{LATEST}' THEN 'censor'
         WHEN intubation_censor_time < death_censor_time THEN 'intubation'
         WHEN died = 1.0 THEN 'death'
         WHEN died = 0 AND intubated = 0 THEN 'recovery' END AS outcome
  FROM basic WHERE intubated IS NOT NULL AND cohort_entry_time <= TIMESTAMP '{ENTRY_LIMIT}')"""


def competing_records(spark, d, kind: str = "intubation", basic: DataFrame | None = None) -> DataFrame:
    """Competing-risk record (status 0 censor, 1 event, 2/3 competing), exclusions applied."""
    basic = basic if basic is not None else basic_table(spark, d)
    b = basic.filter(F.col("intubated").isNotNull() &
                                     (F.col("cohort_entry_time") <= F.lit(ENTRY_LIMIT).cast("timestamp_ntz")))
    latest = F.lit(LATEST).cast("timestamp_ntz")
    if kind == "intubation":
        censor = X.pmin_na("intubation_censor_time", "death_censor_time", latest)
        outcome = F.when(F.least("intubation_censor_time", "death_censor_time") > latest, "censor") \
            .when(F.col("intubation_censor_time") < F.col("death_censor_time"), "intubation") \
            .when(F.col("died") == 1.0, "death") \
            .when((F.col("died") == 0) & (F.col("intubated") == 0), "recovery")
        status_map = {"censor": 0, "intubation": 1, "death": 2, "recovery": 3}
    else:
        censor = X.pmin_na("death_censor_time", latest)
        outcome = F.when(F.col("death_censor_time") > latest, "censor").when(F.col("died") == 1.0, "death") \
            .otherwise("recovery")
        status_map = {"censor": 0, "death": 1, "recovery": 2}
    r = b.withColumn("censor_time", censor).withColumn("outcome", outcome)
    r = r.withColumn("survival_time", X.days_between("censor_time", "cohort_entry_time"))
    r = r.filter((F.col("cohort_entry_time") <= F.col("censor_time")) &
                 (F.col("dnr_date").isNull() | (F.col("dnr_date") > F.col("censor_time"))) if kind == "intubation"
                 else (F.col("cohort_entry_time") <= F.col("censor_time")))
    return r.withColumn("status", X.map_recode("outcome", status_map))


@register("competing_risk_records", with_ctes(["consistent", "tests"], COHORT_SQL + BASIC_SQL + CR_SQL + """
SELECT person, abo, rh, outcome, ROUND((epoch_us(censor_time) - epoch_us(cohort_entry_time)) / 86400000000.0, 6)
  AS survival_time
FROM cr WHERE cohort_entry_time <= censor_time AND (dnr_date IS NULL OR dnr_date > censor_time)"""))
def competing_risk_records(spark, d):
    """Intubation record with death as competing risk, DNR and pre-entry exclusions (Q13 pmin)."""
    r = competing_records(spark, d, "intubation")
    return r.select("person", "abo", "rh", "outcome", _r("survival_time").alias("survival_time"))


@register("death_records", with_ctes(["consistent", "tests"], COHORT_SQL + BASIC_SQL + f"""
, dr AS (SELECT person, abo, rh, cohort_entry_time, LEAST(death_censor_time, TIMESTAMP '{LATEST}') AS censor_time,
    CASE WHEN death_censor_time > TIMESTAMP '{LATEST}' THEN 'censor' WHEN died = 1.0 THEN 'death' ELSE 'recovery' END AS outcome
  FROM basic WHERE intubated IS NOT NULL AND death_censor_time IS NOT NULL AND cohort_entry_time <= TIMESTAMP '{ENTRY_LIMIT}')
SELECT person, abo, rh, outcome, CAST(CASE outcome WHEN 'censor' THEN 0 WHEN 'death' THEN 1 ELSE 2 END AS INTEGER) AS status,
  ROUND((epoch_us(censor_time) - epoch_us(cohort_entry_time)) / 86400000000.0, 6) AS survival_time
FROM dr WHERE cohort_entry_time <= censor_time"""))
def death_records(spark, d):
    """Death record with recovery competing, pre-entry exclusions."""
    r = competing_records(spark, d, "death")
    return r.select("person", "abo", "rh", "outcome", F.col("status").cast("int").alias("status"), _r("survival_time").alias("survival_time"))


@register("prevalence_flags", """
WITH v AS (SELECT user_id AS person, ts, CASE WHEN event_type = 'purchase' AND value >= 150.0 THEN 1 ELSE 0 END AS pos
           FROM events WHERE event_type NOT IN ('error')),
f AS (SELECT person, MIN(ts) AS first_ts FROM v GROUP BY person)
SELECT v.person, MAX(pos) AS ever_pos,
  MAX(CASE WHEN pos = 1 AND (epoch_us(ts) - epoch_us(first_ts)) / 3600000000.0 <= 96 THEN 1 ELSE 0 END) AS initial_pos
FROM v JOIN f ON v.person = f.person GROUP BY v.person""")
def prevalence_flags(spark, d):
    """Ever positive and positive within 96 h of the first test."""
    ev = table(spark, d, "events").filter(~F.col("event_type").isin(D.INVALID_RESULTS)).select(
        F.col("user_id").alias("person"), "ts",
        ((F.col("event_type") == "purchase") & (F.col("value") >= D.POSITIVE_VALUE)).cast("int").alias("pos"))
    # the earliest positive test decides whether any lies within the window of the first test: one aggregate
    s = ev.groupBy("person").agg(F.min("ts").alias("first"), F.max("pos").alias("ever_pos"),
                                 F.min(F.when(F.col("pos") == 1, F.col("ts"))).alias("positive"))
    early = X.micros_between("positive", "first") <= 96 * 3_600_000_000
    return s.select("person", "ever_pos", F.coalesce(early, F.lit(False)).cast("int").alias("initial_pos"))


@register("flow_counts", with_ctes(["consistent", "tests"], """
SELECT 0 AS step_order, 'customers' AS step, COUNT(DISTINCT c_custkey) AS n FROM customer
UNION ALL SELECT 1, 'tested', COUNT(DISTINCT person) FROM tests
UNION ALL SELECT 2, 'typed', COUNT(DISTINCT person) FROM typed
UNION ALL SELECT 3, 'consistent', COUNT(DISTINCT person) FROM consistent
UNION ALL SELECT 4, 'cohort', COUNT(DISTINCT person) FROM consistent JOIN tests USING (person)"""))
def flow_counts(spark, d):
    """Cohort-flow counts."""
    cons = D.consistent_types(spark, d)
    tests = D.test_results(spark, d)
    return A.flow([("customers", table(spark, d, "customer").select(F.col("c_custkey").alias("person"))),
                   ("tested", tests), ("typed", D.typed(spark, d)), ("consistent", cons),
                   ("cohort", cons.join(tests, "person"))], key="person")


# ====================================================================== contingency and tests (K1-K5)

ARMS = {"covid_positive": "cov_pos", "total_tested": 1}
COMPL = {"covid_negative": ("total_tested", "covid_positive")}
COMPARISONS = {"positive_vs_general": ["covid_positive", "general_pop"],
               "positive_vs_negative": ["covid_positive", "covid_negative"]}


def typed_contingency(spark, d) -> DataFrame:
    fams = {"abo": ["abo"], "rh": ["rh"], "abo_rh": ["abo", "rh"]}
    cons = D.consistent_types(spark, d)
    cont = K.contingency(D.tested_persons(spark, d, cons), fams, ARMS, COMPL)
    gen = A.grouped_levels(D.general_population(spark, d, cons), fams, [F.count(F.lit(1)).alias("n")], total=None) \
        .withColumn("arm", F.lit("general_pop"))
    return K.add_external(cont, gen)


CONT_SQL = """
, wide AS (
  SELECT 'abo' AS family, abo AS grp, SUM(cov_pos) AS pos, COUNT(*) AS tot FROM tested GROUP BY abo
  UNION ALL SELECT 'rh', rh, SUM(cov_pos), COUNT(*) FROM tested GROUP BY rh
  UNION ALL SELECT 'abo_rh', abo || '-' || rh, SUM(cov_pos), COUNT(*) FROM tested GROUP BY abo, rh)
, gen AS (
  SELECT 'abo' AS family, abo AS grp, COUNT(*) AS n FROM general GROUP BY abo
  UNION ALL SELECT 'rh', rh, COUNT(*) FROM general GROUP BY rh
  UNION ALL SELECT 'abo_rh', abo || '-' || rh, COUNT(*) FROM general GROUP BY abo, rh)
, cont AS (
  SELECT family, grp AS "group", 'covid_positive' AS arm, CAST(pos AS BIGINT) AS n FROM wide
  UNION ALL SELECT family, grp, 'total_tested', CAST(tot AS BIGINT) FROM wide
  UNION ALL SELECT family, grp, 'covid_negative', CAST(tot - pos AS BIGINT) FROM wide
  UNION ALL SELECT family, grp, 'general_pop', CAST(n AS BIGINT) FROM gen)"""


@register("contingency_typed", with_ctes(["tested", "general"], CONT_SQL + "\nSELECT family, \"group\", arm, n FROM cont"))
def contingency_typed(spark, d):
    """Long contingency per family x group x arm incl. the comparison population."""
    return typed_contingency(spark, d)


CFG_SQL = """
, cfg AS (SELECT * FROM (VALUES ('positive_vs_general', 'covid_positive', 0), ('positive_vs_general', 'general_pop', 1),
          ('positive_vs_negative', 'covid_positive', 0), ('positive_vs_negative', 'covid_negative', 1)) t(comparison, arm, col_idx))"""


def _chisq_sql(source: str, part: str) -> str:
    """Oracle chi-squared: zero-completed grid, Yates on 2x2, NULL when an expected count is 0, any df."""
    x = "x"
    return f"""
, src AS (SELECT * FROM {source})
, obs AS (SELECT {part}, comparison, "group", col_idx, CAST(n AS DOUBLE) AS o FROM src JOIN cfg USING (arm))
, grid AS (SELECT g.*, c.comparison, c.col_idx FROM (SELECT DISTINCT {part}, "group" FROM src) g
           CROSS JOIN (SELECT DISTINCT comparison, col_idx FROM cfg) c)
, j AS (SELECT grid.*, COALESCE(obs.o, 0) AS o FROM grid LEFT JOIN obs USING ({part}, comparison, "group", col_idx))
, e AS (SELECT *, SUM(o) OVER (PARTITION BY {part}, comparison, "group") * SUM(o) OVER (PARTITION BY {part}, comparison, col_idx)
               / SUM(o) OVER (PARTITION BY {part}, comparison) AS ex FROM j)
, dims AS (SELECT {part}, comparison, COUNT(DISTINCT "group") AS nr, COUNT(DISTINCT col_idx) AS nc,
                  MIN(abs(o - ex)) AS mind, MIN(ex) AS minex FROM e GROUP BY ALL)
, y AS (SELECT e.*, nr, nc, minex, CASE WHEN nr = 2 AND nc = 2 THEN LEAST(0.5, mind) ELSE 0.0 END AS yates
        FROM e JOIN dims USING ({part}, comparison))
, s AS (SELECT {part}, comparison,
          CASE WHEN MIN(minex) > 0 THEN SUM(pow(abs(o - ex) - yates, 2) / ex) END AS x,
          CAST((MAX(nr) - 1) * (MAX(nc) - 1) AS INTEGER) AS parameter, MAX(yates) > 0 AS yt FROM y GROUP BY ALL)
SELECT {part}, comparison, ROUND({x}, 6) AS statistic, parameter, ROUND({D.sql_chi2_sf(x, "parameter")}, 8) AS p_value,
       CASE WHEN yt THEN 'Pearson''s Chi-squared test with Yates'' continuity correction'
            ELSE 'Pearson''s Chi-squared test' END AS method FROM s"""


def _chisq_out(df: DataFrame, keys) -> DataFrame:
    return df.select(*keys, "comparison", _r("statistic").alias("statistic"), "parameter",
                     _r("p_value", 8).alias("p_value"), "method")


@register("chisq_typed", with_ctes(["tested", "general"], CONT_SQL + CFG_SQL + _chisq_sql("cont", "family")))
def chisq_typed(spark, d):
    """K2: Pearson chi-squared per family (ABO-, Rh- (2x2, Yates) and joint analogue), two arm pairs."""
    return _chisq_out(K.chisq(typed_contingency(spark, d), COMPARISONS, keys=["family"]), ["family"])


def segment_contingency(spark, d) -> DataFrame:
    ct = D.customers_tested(spark, d)
    cont = K.contingency(ct, {"segment": ["c_mktsegment"]}, ARMS, COMPL)
    users = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    gen = rel.anti(table(spark, d, "customer"), users, "c_custkey").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"))
    gen = gen.select(F.lit("segment").alias("family"), F.col("c_mktsegment").alias("group"),
                     F.lit("general_pop").alias("arm"), "n")
    return K.add_external(cont, gen)


SEG_SQL = """
, wide AS (SELECT c_mktsegment AS grp, SUM(cov_pos) AS pos, COUNT(*) AS tot FROM ctested GROUP BY c_mktsegment)
, gen AS (SELECT c_mktsegment AS grp, COUNT(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
          GROUP BY c_mktsegment)
, cont AS (
  SELECT 'segment' AS family, grp AS "group", 'covid_positive' AS arm, CAST(pos AS BIGINT) AS n FROM wide
  UNION ALL SELECT 'segment', grp, 'total_tested', CAST(tot AS BIGINT) FROM wide
  UNION ALL SELECT 'segment', grp, 'covid_negative', CAST(tot - pos AS BIGINT) FROM wide
  UNION ALL SELECT 'segment', grp, 'general_pop', CAST(n AS BIGINT) FROM gen)"""


@register("chisq_segment", with_ctes(["ctested"], SEG_SQL + CFG_SQL + _chisq_sql("cont", "family")))
def chisq_segment(spark, d):
    """Flagship K2: tested customers by segment, positive vs negative and vs never-tested (df 4)."""
    return _chisq_out(K.chisq(segment_contingency(spark, d), COMPARISONS, keys=["family"]), ["family"])


@register("crosstab_chisq", """
WITH ct AS (SELECT p.o_orderpriority, s.o_orderstatus, COUNT(o.o_orderkey) AS n
  FROM (SELECT DISTINCT o_orderpriority FROM orders) p CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) s
  LEFT JOIN orders o ON o.o_orderpriority = p.o_orderpriority AND o.o_orderstatus = s.o_orderstatus GROUP BY ALL),
e AS (SELECT *, SUM(n) OVER (PARTITION BY o_orderpriority) * SUM(n) OVER (PARTITION BY o_orderstatus) / SUM(n) OVER () AS ex FROM ct),
s AS (SELECT SUM(pow(n - ex, 2) / ex) AS x, CAST((COUNT(DISTINCT o_orderpriority) - 1) * (COUNT(DISTINCT o_orderstatus) - 1) AS INTEGER) AS parameter FROM e)
SELECT 'o_orderpriority_vs_o_orderstatus' AS comparison, ROUND(x, 6) AS statistic, parameter,
  ROUND(""" + D.sql_chi2_sf("x", "parameter") + """, 8) AS p_value,
  'Pearson''s Chi-squared test' AS method FROM s""")
def crosstab_chisq(spark, d):
    """Chi-squared of two categoricals with the zero-filled crosstab (5 x 3, df 8)."""
    return _chisq_out(K.chisq_crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus"), [])


@register("fisher_pvalue_segment", with_ctes(["ctested"], SEG_SQL + CFG_SQL + """
, j AS (SELECT family, comparison, "group", col_idx, n FROM cont JOIN cfg USING (arm))
, own AS (SELECT family, comparison, "group" AS blood_group, CAST(COALESCE(SUM(CASE WHEN col_idx = 0 THEN n END), 0) AS BIGINT) AS a,
                 CAST(COALESCE(SUM(CASE WHEN col_idx = 1 THEN n END), 0) AS BIGINT) AS b FROM j GROUP BY ALL)
, t AS (SELECT o.*, CAST(SUM(a) OVER (PARTITION BY family, comparison) - a AS BIGINT) AS c,
               CAST(SUM(b) OVER (PARTITION BY family, comparison) - b AS BIGINT) AS d FROM own o)
, sup AS (SELECT t.*, x, lgamma(a + c + 1) - lgamma(x + 1) - lgamma(a + c - x + 1)
                 + lgamma(b + d + 1) - lgamma(a + b - x + 1) - lgamma(b + d - (a + b - x) + 1) AS ld
          FROM t, LATERAL generate_series(GREATEST(0, a + b - (b + d)), LEAST(a + b, a + c)) g(x))
, s2 AS (SELECT *, MAX(ld) OVER w AS mx, MAX(CASE WHEN x = a THEN ld END) OVER w AS lobs FROM sup
         WINDOW w AS (PARTITION BY family, comparison, blood_group))
SELECT family, comparison, blood_group, a, b, c, d,
  ROUND(LEAST(1.0, SUM(CASE WHEN exp(ld - mx) <= exp(lobs - mx) * (1 + 1e-7) THEN exp(ld - mx) ELSE 0 END)
        / SUM(exp(ld - mx))), 8) AS p_value
FROM s2 GROUP BY family, comparison, blood_group, a, b, c, d"""))
def fisher_pvalue_segment(spark, d):
    """K5 (exact two-sided p, native support explode) one-vs-rest per segment and comparison."""
    t = K.one_vs_rest_2x2(segment_contingency(spark, d), COMPARISONS, keys=["family"])
    return K.fisher_pvalue(t).withColumn("p_value", _r("p_value", 8))


def _fisher_root_sql(rounds: int = 12, points: int = 24) -> str:
    """Roots of the conditional likelihood by sections of a bracket over the whole support of each table."""
    body = """
, j AS (SELECT family, comparison, "group", col_idx, n FROM cont JOIN cfg USING (arm))
, own AS (SELECT family, comparison, "group" AS blood_group, CAST(COALESCE(SUM(CASE WHEN col_idx = 0 THEN n END), 0) AS BIGINT) AS a,
                 CAST(COALESCE(SUM(CASE WHEN col_idx = 1 THEN n END), 0) AS BIGINT) AS b FROM j GROUP BY ALL)
, t AS MATERIALIZED (SELECT o.*, CAST(SUM(a) OVER w - a AS BIGINT) AS c, CAST(SUM(b) OVER w - b AS BIGINT) AS d,
          row_number() OVER (ORDER BY family, comparison, blood_group) AS id FROM own o WINDOW w AS (PARTITION BY family, comparison))
, sup AS (SELECT id, a, x, lgamma(a + c + 1) - lgamma(x + 1) - lgamma(a + c - x + 1)
                 + lgamma(b + d + 1) - lgamma(a + b - x + 1) - lgamma(b + d - (a + b - x) + 1) AS ld
          FROM t, LATERAL generate_series(GREATEST(0, a + b - (b + d)), LEAST(a + b, a + c)) g(x))
, s AS MATERIALIZED (SELECT id, x - a AS dx, ld - MAX(CASE WHEN x = a THEN ld END) OVER (PARTITION BY id) AS lf, ld - MAX(ld) OVER (PARTITION BY id) AS lm FROM sup)
, pv AS (SELECT id, LEAST(1.0, SUM(CASE WHEN lf <= ln(1 + 1e-7) THEN exp(lm) ELSE 0 END) / SUM(exp(lm))) AS p FROM s GROUP BY id)
, r0 AS (SELECT id, k, -30.0::DOUBLE AS lo, 30.0::DOUBLE AS hi FROM t, (VALUES ('est'), ('low'), ('high')) v(k))"""
    for i in range(rounds):
        body += f"""
, p{i} AS (SELECT id, k, lo, hi, lo + (hi - lo) * i / {points + 1}.0::DOUBLE AS t FROM r{i}, (SELECT unnest(range(1, {points + 1})) AS i))
, v{i} AS (SELECT id, k, lo, hi, t, CASE k WHEN 'est' THEN SUM(dx * exp(LEAST(lf + t * dx, 600))) / SUM(exp(LEAST(lf + t * dx, 600)))
      WHEN 'low' THEN SUM(CASE WHEN dx >= 0 THEN exp(LEAST(lf + t * dx, 600)) ELSE 0 END) / SUM(exp(LEAST(lf + t * dx, 600))) - 0.025
      ELSE 0.025 - SUM(CASE WHEN dx <= 0 THEN exp(LEAST(lf + t * dx, 600)) ELSE 0 END) / SUM(exp(LEAST(lf + t * dx, 600))) END AS f
    FROM p{i} JOIN s USING (id) GROUP BY id, k, lo, hi, t)
, r{i + 1} AS MATERIALIZED (SELECT id, k, COALESCE(MAX(t) FILTER (WHERE f < 0), ANY_VALUE(lo)) AS lo, COALESCE(MIN(t) FILTER (WHERE f >= 0), ANY_VALUE(hi)) AS hi
    FROM v{i} GROUP BY id, k)"""
    return body + f"""
, root AS (SELECT id, MAX(exp((lo + hi) / 2)) FILTER (WHERE k = 'est') AS est, MAX(exp((lo + hi) / 2)) FILTER (WHERE k = 'low') AS low,
    MAX(exp((lo + hi) / 2)) FILTER (WHERE k = 'high') AS high FROM r{rounds} GROUP BY id)
SELECT family, comparison, blood_group, a, b, c, d,
  ROUND(CASE WHEN a = GREATEST(0, a - d) THEN 0.0 WHEN a = LEAST(a + b, a + c) THEN 'inf'::DOUBLE ELSE est END, 6) AS estimate,
  ROUND(CASE WHEN a = GREATEST(0, a - d) THEN 0.0 ELSE low END, 6) AS conf_low,
  ROUND(CASE WHEN a = LEAST(a + b, a + c) THEN 'inf'::DOUBLE ELSE high END, 6) AS conf_high, ROUND(p, 8) AS p_value,
  'Fisher''s Exact Test for Count Data' AS method, 'two.sided' AS alternative FROM t JOIN root USING (id) JOIN pv USING (id)"""


@register("fisher_exact_segment", with_ctes(["ctested"], SEG_SQL + CFG_SQL + _fisher_root_sql()))
def fisher_exact_segment(spark, d):
    """K5 full: conditional-MLE odds ratio, 95% CI and p; brackets of all tables narrowed together."""
    t = K.one_vs_rest_2x2(segment_contingency(spark, d), COMPARISONS, keys=["family"])
    out = K.fisher_exact(t)
    return out.select(*t.columns, *[_r(c).alias(c) for c in ("estimate", "conf_low", "conf_high")], _r("p_value", 8).alias("p_value"), "method", "alternative")


# ====================================================================== models

def _logit_input(spark, d):
    ct = D.customers_tested(spark, d)
    return R.one_hot(ct, "c_mktsegment", SEGMENTS, prefix="seg", sep="_")


SEG_TERMS = [f"seg_{s}" for s in SEGMENTS]


def _closed_form_logit_sql(prefix_ctes: str, outcomes: list[tuple[str, str, str]]) -> str:
    """Saturated one-factor logistic model in closed form (last level aliased = reference)."""
    parts = []
    for outcome, ycol, where in outcomes:
        parts.append(f"SELECT '{outcome}' AS outcome, c_mktsegment AS seg, CAST(SUM({ycol}) AS DOUBLE) AS y, "
                     f"CAST(COUNT(*) AS DOUBLE) AS n FROM ctested_o WHERE {where} GROUP BY c_mktsegment")
    g = "\n  UNION ALL ".join(parts)
    return prefix_ctes + f"""
, g AS ({g})
, ref AS (SELECT outcome, y AS yr, n AS nr FROM g WHERE seg = 'MACHINERY')
, coef AS (
  SELECT outcome, 'segment' AS model, '(Intercept)' AS term, ln(yr / (nr - yr)) AS est, sqrt(1 / yr + 1 / (nr - yr)) AS se FROM ref
  UNION ALL SELECT g.outcome, 'segment', 'seg_' || seg, ln(y / (n - y)) - ln(yr / (nr - yr)),
         sqrt(1 / y + 1 / (n - y) + 1 / yr + 1 / (nr - yr)) FROM g JOIN ref USING (outcome) WHERE seg <> 'MACHINERY'
  UNION ALL SELECT outcome, 'null', '(Intercept)', ln(SUM(y) / (SUM(n) - SUM(y))), sqrt(1 / SUM(y) + 1 / (SUM(n) - SUM(y)))
         FROM g GROUP BY outcome)"""


LOGIT_PREFIX = """
, outc AS (SELECT user_id AS person, MAX(CASE WHEN event_type = 'signup' AND value >= 150.0 THEN 1 ELSE 0 END) AS intubated
           FROM events GROUP BY user_id)
, ctested_o AS (SELECT ct.*, outc.intubated FROM ctested ct JOIN outc ON ct.person = outc.person)"""

LOGIT_OUTCOMES = [("cov_pos", "cov_pos", "TRUE"), ("intubated", "intubated", "cov_pos = 1")]


def _logit_grid(spark, d):
    ct = _logit_input(spark, d).join(D.outcome_flags(spark, d).select("person", "intubated"), "person")
    grid, terms = glm.model_grid(ct, {"cov_pos": ("cov_pos", None), "intubated": ("intubated", "cov_pos = 1")},
                                 {"null": [], "segment": SEG_TERMS})
    # tight tolerance: the oracle is the exact (closed-form) MLE; R's default 1e-8 stops a little short
    return glm.logit_grouped(grid, ["outcome", "model"], "__y_val", terms, epsilon=1e-14)


@register("logit_grid", with_ctes(["ctested"], _closed_form_logit_sql(LOGIT_PREFIX, LOGIT_OUTCOMES) + """
SELECT outcome, model, term, ROUND(est, 5) AS estimate, ROUND(se, 5) AS std_error, ROUND(est / se, 5) AS statistic,
  ROUND(""" + D.sql_norm_p("est / se") + """, 7) AS p_value
FROM coef"""))
def logit_grid(spark, d):
    """Outcome x formula grid fitted by batched IRLS; aliased last level dropped."""
    coefs, _fits = _logit_grid(spark, d)
    return coefs.select("outcome", "model", "term", _r("estimate", 5).alias("estimate"),
                        _r("std_error", 5).alias("std_error"), _r("statistic", 5).alias("statistic"),
                        _r("p_value", 7).alias("p_value"))


@register("deviance_grid", with_ctes(["ctested"], LOGIT_PREFIX + """
, g AS (SELECT 'cov_pos' AS outcome, c_mktsegment AS seg, CAST(SUM(cov_pos) AS DOUBLE) AS y, CAST(COUNT(*) AS DOUBLE) AS n
        FROM ctested_o GROUP BY c_mktsegment
        UNION ALL SELECT 'intubated', c_mktsegment, CAST(SUM(intubated) AS DOUBLE), CAST(COUNT(*) AS DOUBLE)
        FROM ctested_o WHERE cov_pos = 1 GROUP BY c_mktsegment)
, fit AS (SELECT outcome, SUM(n) AS nobs, -2 * SUM(y * ln(y / n) + (n - y) * ln(1 - y / n)) AS dev_seg,
            -2 * (SUM(y) * ln(SUM(y) / SUM(n)) + (SUM(n) - SUM(y)) * ln(1 - SUM(y) / SUM(n))) AS dev_null,
            COUNT(*) AS k FROM g GROUP BY outcome)
SELECT outcome, 'segment_vs_null' AS comparison, 1 AS "row", nobs - 1 AS resid_df, ROUND(dev_null, 5) AS resid_dev,
  CAST(NULL AS DOUBLE) AS df, CAST(NULL AS DOUBLE) AS deviance, CAST(NULL AS DOUBLE) AS p_value FROM fit
UNION ALL
SELECT outcome, 'segment_vs_null', 2, nobs - k, ROUND(dev_seg, 5), CAST(k - 1 AS DOUBLE), ROUND(dev_null - dev_seg, 5),
  ROUND(""" + D.sql_chi2_sf("dev_null - dev_seg", "k - 1") + """, 6) FROM fit"""))
def deviance_grid(spark, d):
    """Analysis of deviance (null vs segment) per outcome, two rows per comparison (df 4)."""
    _coefs, fits = _logit_grid(spark, d)
    t = glm.deviance_table(fits, {"segment_vs_null": ("null", "segment")}, keys=["outcome"])
    return t.select("outcome", "comparison", "row", "resid_df", _r("resid_dev", 5).alias("resid_dev"), "df",
                    _r("deviance", 5).alias("deviance"), _r("p_value", 6).alias("p_value"))


@register("odds_ratio_segment", with_ctes(["ctested"], _closed_form_logit_sql(LOGIT_PREFIX, LOGIT_OUTCOMES[:1]) + """
SELECT term, ROUND(exp(est), 5) AS odds_ratio, ROUND(exp(est - 1.96 * se), 5) AS conf_low,
       ROUND(exp(est + 1.96 * se), 5) AS conf_high FROM coef WHERE model = 'segment' AND term <> '(Intercept)'"""))
def odds_ratio_segment(spark, d):
    """Exponentiated coefficients with Wald 95% CI."""
    coefs, _ = glm.logit(_logit_input(spark, d), "cov_pos", SEG_TERMS, epsilon=1e-14)
    o = glm.odds_ratio(coefs).filter(F.col("term") != glm.INTERCEPT)
    return o.select("term", _r("odds_ratio", 5).alias("odds_ratio"), _r("conf_low", 5).alias("conf_low"),
                    _r("conf_high", 5).alias("conf_high"))


@register("corr_lineitem", """
SELECT var1, var2, ROUND(c, 8) AS corr FROM (
  SELECT 'l_extendedprice' AS var1, 'l_quantity' AS var2, corr(l_extendedprice, l_quantity) AS c FROM lineitem
  UNION ALL SELECT 'l_discount', 'l_quantity', corr(l_discount, l_quantity) FROM lineitem
  UNION ALL SELECT 'l_discount', 'l_extendedprice', corr(l_discount, l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_tax', 'l_quantity', corr(l_tax, l_quantity) FROM lineitem
  UNION ALL SELECT 'l_tax', 'l_extendedprice', corr(l_tax, l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_tax', 'l_discount', corr(l_tax, l_discount) FROM lineitem) u""")
def corr_lineitem(spark, d):
    """Lower-triangle correlation matrix in long form, one pass."""
    c = A.corr_long(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return c.select("var1", "var2", _r("corr", 8).alias("corr"))


def _ols_risks(spark, d):
    ct = _logit_input(spark, d)
    coefs, _fits = glm.ols_grouped(ct, [], "cov_pos", SEG_TERMS)
    strata = {s: {t: (1.0 if t == f"seg_{s}" else 0.0) for t in SEG_TERMS} for s in SEGMENTS}
    return resample.standardised_mean(ct, [], strata,
                                      lambda x: glm.predict_linear(x, coefs, SEG_TERMS, out="pred"))


@register("standardised_risk_effects", with_ctes(["ctested"], """
, r AS (SELECT c_mktsegment AS stratum, AVG(cov_pos) AS risk FROM ctested GROUP BY c_mktsegment)
, ref AS (SELECT risk AS reference_risk FROM r WHERE stratum = 'MACHINERY')
SELECT stratum, ROUND(risk, 6) AS risk, ROUND(risk - reference_risk, 6) AS risk_difference,
  ROUND(CASE WHEN risk - reference_risk <> 0 THEN 1 / (risk - reference_risk) END, 4) AS nnt,
  ROUND(risk / reference_risk, 6) AS relative_risk FROM r, ref"""))
def standardised_risk_effects(spark, d):
    """OLS (linear probability), g-computation per stratum, RD / NNT / RR vs reference."""
    risks = _ols_risks(spark, d)
    e = resample.effects(risks, [], "MACHINERY")
    return e.select("stratum", _r("risk").alias("risk"), _r("risk_difference").alias("risk_difference"),
                    _r("nnt", 4).alias("nnt"), _r("relative_risk").alias("relative_risk"))


N_BOOT = 1000


@register("bootstrap_risk_ci", with_ctes(["ctested"], f"""
, drawn AS (SELECT c_mktsegment, b, cov_pos, {vectors.sql_draw("person", "b")} AS w
            FROM ctested, (SELECT unnest(range(0, {N_BOOT + 1})) AS b))
, r AS (SELECT c_mktsegment, b, CASE WHEN SUM(w) > 0 THEN SUM(w * cov_pos)::DOUBLE / SUM(w) END AS risk FROM drawn GROUP BY c_mktsegment, b)
SELECT c_mktsegment, ROUND(MAX(risk) FILTER (WHERE b = 0), 8) AS risk, ROUND(quantile_cont(risk, 0.025) FILTER (WHERE b > 0), 8) AS risk_conf_low,
  ROUND(quantile_cont(risk, 0.975) FILTER (WHERE b > 0), 8) AS risk_conf_high,
  COUNT(risk) FILTER (WHERE b > 0) AS n_boot_used, COUNT(*) FILTER (WHERE b > 0 AND risk IS NULL) AS n_failed
FROM r GROUP BY c_mktsegment"""))
def bootstrap_risk_ci(spark, d, n_boot: int = N_BOOT):
    """Poisson bootstrap (seeded hash draws) of per-segment risks, percentile 95% intervals. Multiplicities are
    vectors per pattern (segment, outcome); ten patterns become rows per iteration, persons never do."""
    ct = D.customers_tested(spark, d)
    seg = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment"))
    pats = vectors.pattern_vectors(ct.withColumn("seg", seg), "person", ["seg", "cov_pos"], n_boot)
    w = vectors.iteration_rows(pats, n_boot)
    risks = w.groupBy("bootstrap_iteration", F.element_at(F.array(*map(F.lit, SEGMENTS)), F.col("seg").cast("int")).alias("c_mktsegment")).agg(
        F.try_divide(F.sum(F.col("boot_w") * F.col("cov_pos")), F.sum("boot_w")).alias("risk"))
    ci = resample.percentile_ci(risks, ["c_mktsegment"], ["risk"])
    return ci.select("c_mktsegment", *[_r(c, 8).alias(c) for c in ("risk", "risk_conf_low", "risk_conf_high")], "n_boot_used", "n_failed")


@register("fine_gray_intubation", None)
def fine_gray_intubation(spark, d):
    """Fine-Gray for intubation (death competing) on ABO-analogue dummies, unadjusted and
    adjusted, with standardised cumulative incidence per stratum."""
    r = competing_records(spark, d, "intubation")
    r = R.dummy(r, "abo", ["A", "N", "R"], drop=False, prefix="abo", sep="_")
    r = R.dummy(r, "race", ["white", "black", "asian", "other"], drop=False, prefix="race", sep="_")
    models = {"unadjusted": ["abo_N", "abo_R"], "adjusted": ["abo_N", "abo_R", "race_black", "race_asian",
                                                              "race_other", "hispanic"]}
    allx = models["adjusted"]
    frames = []
    for m, xs in models.items():
        rr = r.withColumn("model", F.lit(m))
        for x in allx:
            if x not in xs:
                rr = rr.withColumn(x, F.lit(0.0))
        frames.append(rr)
    # model input is re-read by the fit and the standardisation: cut its (deep) lineage once
    data = cut_lineage(rel.union_all(frames).select("model", "survival_time", "status", *allx))
    coefs, base, _fits = survival.fine_gray(data, ["model"], "survival_time", "status", allx)
    coefs = coefs.filter(~((F.col("model") == "unadjusted") & ~F.col("term").isin(models["unadjusted"])))
    strata = {"A": {"abo_N": 0.0, "abo_R": 0.0}, "N": {"abo_N": 1.0, "abo_R": 0.0}, "R": {"abo_N": 0.0, "abo_R": 1.0}}
    risks = resample.standardised_mean(
        data, ["model"], strata, lambda x: survival.predict_cif_last(x, coefs, base, allx, keys=["model"]))
    return risks.select("model", "stratum", "risk")


@register("meta_regions", """
WITH tests AS (SELECT user_id AS person, MAX(CASE WHEN event_type = 'purchase' AND value >= 150.0 THEN 1 ELSE 0 END) AS cov_pos
               FROM events WHERE event_type NOT IN ('error') GROUP BY user_id),
base AS (SELECT r_name AS site, c_mktsegment AS grp, c_custkey, t.cov_pos FROM customer
         JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
         LEFT JOIN tests t ON c_custkey = t.person),
counts AS (SELECT site, grp, CAST(SUM(CASE WHEN cov_pos = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS cases,
                  CAST(SUM(CASE WHEN cov_pos IS NULL THEN 1 ELSE 0 END) AS DOUBLE) AS controls FROM base GROUP BY site, grp),
st AS (SELECT c.grp AS target, c.site, c.cases AS a, tot.tc - c.cases AS b, c.controls AS c, tot.tk - c.controls AS d
       FROM counts c JOIN (SELECT site, SUM(cases) AS tc, SUM(controls) AS tk FROM counts GROUP BY site) tot USING (site)),
st2 AS (SELECT *, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5 ELSE 0.0 END AS inc FROM st),
ef AS (SELECT target, site, ln((a + inc) * (d + inc) / ((b + inc) * (c + inc))) AS y,
              1 / (a + inc) + 1 / (b + inc) + 1 / (c + inc) + 1 / (d + inc) AS v FROM st2),
fx AS (SELECT target, SUM(1 / v) AS sw, SUM(y / v) AS swy, SUM(1 / (v * v)) AS sw2, SUM(y * y / v) AS swy2, COUNT(*) AS k
       FROM ef GROUP BY target),
het AS (SELECT target, k, GREATEST(swy2 - swy * swy / sw, 0) AS q,
               GREATEST(0, (GREATEST(swy2 - swy * swy / sw, 0) - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM fx),
rnd AS (SELECT ef.target, SUM(1 / (v + tau2)) AS swr, SUM(y / (v + tau2)) AS swry FROM ef JOIN het USING (target) GROUP BY ef.target)
SELECT het.target, CAST(k AS BIGINT) AS k, ROUND(swry / swr, 6) AS log_or, ROUND(sqrt(1 / swr), 6) AS se,
  ROUND(exp(swry / swr), 6) AS odds_ratio, ROUND(q, 6) AS q, ROUND(tau2, 6) AS tau2,
  ROUND(GREATEST(0, (q - (k - 1)) / q), 6) AS i2
FROM het JOIN rnd USING (target)""")
def meta_regions(spark, d):
    """sites = regions; per segment target-vs-rest odds ratio of cases vs never-tested controls,
    DerSimonian-Laird random effects pooled across sites."""
    tests = D.test_results(spark, d)
    c = table(spark, d, "customer")
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey) \
        .join(tests, c.c_custkey == tests.person, "left")
    counts = base.groupBy(F.col("r_name").alias("site"), F.col("c_mktsegment").alias("grp")).agg(
        F.count_if(F.col("cov_pos") == 1).cast("double").alias("cases"),
        F.count_if(F.col("cov_pos").isNull()).cast("double").alias("controls"))
    studies = meta.meta_counts(counts, "site", "grp", "cases", "controls")
    _st, pooled, het = meta.meta_binary(studies)
    return pooled.join(het.select("target", "q", "tau2", "i2"), "target").select(
        "target", F.col("k").cast("long").alias("k"), _r("log_or").alias("log_or"), _r("se").alias("se"),
        _r("odds_ratio").alias("odds_ratio"), _r("q").alias("q"), _r("tau2").alias("tau2"), _r("i2").alias("i2"))


# ====================================================================== windows, reshape, misc

@register("share_rest_segment", with_ctes(["ctested"], """
, c AS (SELECT c_mktsegment, CAST(SUM(cov_pos) AS BIGINT) AS n FROM ctested GROUP BY c_mktsegment)
SELECT c_mktsegment, n, ROUND(n / SUM(n) OVER (), 6) AS n_share, CAST(SUM(n) OVER () - n AS BIGINT) AS n_rest,
       ROUND(n / MAX(n) OVER (), 6) AS n_of_max FROM c"""))
def share_rest_segment(spark, d):
    """Share of total, total minus own, share of maximum."""
    c = D.customers_tested(spark, d).groupBy("c_mktsegment").agg(F.sum("cov_pos").cast("long").alias("n"))
    c = A.share_of_max(A.rest(A.share(c, "n"), "n"), "n")
    return c.select("c_mktsegment", "n", _r("n_share").alias("n_share"), "n_rest", _r("n_of_max").alias("n_of_max"))


@register("nations_by_region", """
SELECT r_name, string_agg(n_name, ', ' ORDER BY n_nationkey) AS nations
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def nations_by_region(spark, d):
    """Ordered string aggregation."""
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.join_text(j, ["r_name"], "n_name", order="n_nationkey", out="nations")


@register("histogram_event_value", """
WITH mm AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events),
b AS (SELECT LEAST(CAST(floor((value - lo) / ((hi - lo) / 30.0)) AS BIGINT) + 1, 30) AS bin, lo, hi FROM events, mm)
SELECT bin, ROUND(lo + (bin - 1) * (hi - lo) / 30, 6) AS bin_start, ROUND(lo + bin * (hi - lo) / 30, 6) AS bin_end,
       COUNT(*) AS n FROM b GROUP BY bin, lo, hi""")
def histogram_event_value(spark, d):
    """30 equal-width bins over [min, max]."""
    h = A.histogram(table(spark, d, "events"), "value", 30)
    return h.select("bin", _r("bin_start").alias("bin_start"), _r("bin_end").alias("bin_end"), "n")


@register("widen_status_by_segment", """
SELECT c_mktsegment, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS F,
  CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS O,
  CAST(SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS P
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def widen_status_by_segment(spark, d):
    """Long -> wide pivot with declared levels and zero fill."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    long = o.groupBy("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    w = R.widen(long, ["c_mktsegment"], "o_orderstatus", "n", ["F", "O", "P"], fill=0)
    return w.select("c_mktsegment", *[F.col(c).cast("long").alias(c) for c in ["F", "O", "P"]])


@register("lengthen_customer_numbers", """
SELECT c_custkey, name, value FROM (
  SELECT c_custkey, 'c_acctbal' AS name, c_acctbal AS value FROM customer
  UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer) u""")
def lengthen_customer_numbers(spark, d):
    """R2: wide -> long with unpivot (one scan)."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double"))
    return R.lengthen(c, ["c_custkey"], ["c_acctbal", "c_nationkey"], "name", "value")


@register("one_hot_and_dummy", """
SELECT c_custkey, """ + ", ".join(f"CAST(CASE WHEN c_mktsegment = '{s}' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS seg_{s}" for s in SEGMENTS)
          + ", " + ", ".join(f"CAST(CASE WHEN o_orderstatus = '{s}' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS status_{s}" for s in ["O", "P"]) + """
FROM customer JOIN (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN
   (SELECT MIN(o_orderkey) FROM orders GROUP BY o_custkey)) o ON c_custkey = o_custkey""")
def one_hot_and_dummy(spark, d):
    """Full one-hot and reference-coded dummies (B18 first row per key by aggregate)."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    first = rel.distinct_by(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"),
                            ["o_custkey"], order=["o_orderkey"])
    j = c.join(first, c.c_custkey == first.o_custkey)
    j = R.one_hot(j, "c_mktsegment", SEGMENTS, prefix="seg")
    j = R.dummy(j, "o_orderstatus", ["F", "O", "P"], prefix="status")
    return j.select("c_custkey", *[f"seg_{s}" for s in SEGMENTS], "status_O", "status_P")


@register("first_order_per_customer", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_orderstatus, o_totalprice,
         o_orderpriority) AS rn FROM orders) t WHERE rn = 1""")
def first_order_per_customer(spark, d):
    """One full row per key, deterministic order, via aggregate (skew-safe)."""
    return rel.distinct_by(table(spark, d, "orders"), ["o_custkey"], order=["o_orderdate"])


@register("unite_split", """
SELECT c_custkey, c_mktsegment || '_' || CAST(c_nationkey AS VARCHAR) AS seg_nation, c_mktsegment AS seg,
  c_nationkey AS nation FROM customer""")
def unite_split(spark, d):
    """Unite two columns, split them back with type conversion."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    u = R.unite(c, "seg_nation", ["c_mktsegment", "c_nationkey"], sep="_")
    s = R.split_cols(u, "seg_nation", ["seg", "nation"], sep="_", types={"nation": "int"}, remove=False)
    return s.select("c_custkey", "seg_nation", "seg", "nation")


@register("split_rows_names", """
SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part""")
def split_rows_names(spark, d):
    """Explode a delimited value into rows."""
    return R.split_rows(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("word")), "word", " ")


@register("stratified_counts", with_ctes(["ctested"], LOGIT_PREFIX + """
SELECT 'all_tested' AS outcome, COUNT(*) AS n FROM ctested_o
UNION ALL SELECT 'positives', COUNT(*) FROM ctested_o WHERE cov_pos = 1
UNION ALL SELECT 'intubated_positives', COUNT(*) FROM ctested_o WHERE cov_pos = 1 AND intubated = 1"""))
def stratified_counts(spark, d):
    """Per-outcome inclusion rules as one explode over the rows."""
    ct = D.customers_tested(spark, d).join(D.outcome_flags(spark, d).select("person", "intubated"), "person")
    s = rel.stratify(ct, {"all_tested": F.lit(True), "positives": "cov_pos = 1",
                          "intubated_positives": "cov_pos = 1 AND intubated = 1"})
    return s.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@register("union_distinct_statuses", """
SELECT l_returnflag AS code FROM lineitem UNION SELECT l_linestatus FROM lineitem UNION SELECT o_orderstatus FROM orders""")
def union_distinct_statuses(spark, d):
    """H1/H2: UNION ALL then distinct across three scans."""
    li = table(spark, d, "lineitem")
    return rel.union_distinct([li.select(F.col("l_returnflag").alias("code")),
                               li.select(F.col("l_linestatus").alias("code")),
                               table(spark, d, "orders").select(F.col("o_orderstatus").alias("code"))])


@register("lab_text_values", """
SELECT event_id, TRY_CAST(replace(replace(replace(regexp_extract(props, '[0-9]+') || '%', '<', ''), '>', ''), '%', '')
                          AS DECIMAL(10,5)) AS lab_value
FROM events WHERE event_type = 'view'""")
def lab_text_values(spark, d):
    """Text result -> stripped -> try_cast decimal(10,5)."""
    ev = table(spark, d, "events").filter(F.col("event_type") == "view")
    return ev.select("event_id", X.lab_value(F.concat(F.regexp_extract("props", "[0-9]+", 0), F.lit("%"))).alias("lab_value"))


def _grid_inputs(spark, d):
    """Dummies shared by the prevalence and competing-risk frames (reference levels: A, white, Rh+)."""
    def dummies(df):
        out = R.dummy(df, "abo", ["A", "N", "R"], drop=False, prefix="abo")
        out = R.dummy(out, "race", ["white", "black", "asian", "other"], drop=False, prefix="race")
        return out.withColumn("rh_neg", (F.col("rh") == "neg").cast("double"))
    prev = prevalence_flags(spark, d).select("person", F.col("initial_pos").cast("double").alias("initial_cov_pos"))
    # the time-to-event table feeds three model families: materialise it once (reliable checkpoint)
    basic = cut_lineage(basic_table(spark, d), reread_partitions(spark))
    prevalence = dummies(basic).join(prev, "person")
    comp = {k: dummies(competing_records(spark, d, k, basic)) for k in ("intubation", "death")}
    return prevalence, comp


GRID_EXPOSURES = {"abo": ["abo_N", "abo_R"], "rh": ["rh_neg"]}
GRID_STRATA = {"abo": {"aboA": {"abo_N": 0.0, "abo_R": 0.0}, "aboN": {"abo_N": 1.0, "abo_R": 0.0},
                       "aboR": {"abo_N": 0.0, "abo_R": 1.0}},
               "rh": {"rh1": {"rh_neg": 1.0}, "rh0": {"rh_neg": 0.0}}}
GRID_REFERENCES = {"abo": "aboA", "rh": "rh0"}
GRID_ADJUSTMENTS = {"unadjusted": [], "adjusted": ["race_black", "race_asian", "race_other", "hispanic"]}


@register("risk_grid_linear", with_ctes(["consistent", "tests"], COHORT_SQL + BASIC_SQL + f"""
, v AS (SELECT user_id AS person, ts, CASE WHEN event_type = 'purchase' AND value >= 150.0 THEN 1 ELSE 0 END AS pos
        FROM events WHERE event_type NOT IN ('error'))
, first_v AS (SELECT person, MIN(ts) AS first_ts FROM v GROUP BY person)
, flag AS (SELECT v.person, MAX(CASE WHEN pos = 1 AND (epoch_us(ts) - epoch_us(first_ts)) / 3600000000.0 <= 96 THEN 1 ELSE 0 END) AS y
           FROM v JOIN first_v USING (person) GROUP BY v.person)
, p AS (SELECT person, y, abo, rh FROM basic JOIN flag USING (person))
, drawn AS MATERIALIZED (SELECT p.*, b, {vectors.sql_draw("person", "b")} AS w FROM p, (SELECT unnest(range(0, {N_BOOT + 1})) AS b))
, r AS (SELECT 'abo' AS exposure, 'abo' || abo AS stratum, b, SUM(w * y)::DOUBLE AS num, SUM(w) AS den FROM drawn GROUP BY abo, b
        UNION ALL SELECT 'rh', CASE WHEN rh = 'neg' THEN 'rh1' ELSE 'rh0' END, b, SUM(w * y)::DOUBLE, SUM(w) FROM drawn GROUP BY (rh = 'neg'), CASE WHEN rh = 'neg' THEN 'rh1' ELSE 'rh0' END, b)
, f AS (SELECT *, CASE WHEN MIN(den) OVER (PARTITION BY exposure, b) > 0 THEN num / den END AS risk FROM r)
, e AS (SELECT f.*, f.risk - g.risk AS rd FROM f JOIN f g ON f.exposure = g.exposure AND f.b = g.b AND g.stratum IN ('aboA', 'rh0'))
SELECT exposure, stratum, ROUND(MAX(risk) FILTER (WHERE b = 0), 6) AS risk, ROUND(MAX(rd) FILTER (WHERE b = 0), 6) AS risk_difference,
  ROUND(quantile_cont(risk, 0.025) FILTER (WHERE b > 0), 6) AS risk_conf_low, ROUND(quantile_cont(risk, 0.975) FILTER (WHERE b > 0), 6) AS risk_conf_high,
  ROUND(quantile_cont(rd, 0.025) FILTER (WHERE b > 0), 6) AS risk_difference_conf_low,
  ROUND(quantile_cont(rd, 0.975) FILTER (WHERE b > 0), 6) AS risk_difference_conf_high,
  COUNT(risk) FILTER (WHERE b > 0) AS n_boot_used, COUNT(*) FILTER (WHERE b > 0 AND risk IS NULL) AS n_failed
FROM e GROUP BY exposure, stratum"""))
def risk_grid_linear(spark, d, n_boot: int = N_BOOT):
    """K22-K26, the linear part without adjustment (the oracle redraws the multiplicities): risks, differences to the
    reference stratum, percentile intervals and how many resamples they rest on."""
    from . import risk
    prevalence, _ = _grid_inputs(spark, d)
    grid = risk.Grid(GRID_EXPOSURES, GRID_STRATA, {"unadjusted": []})
    r = risk.linear_risks(prevalence, "initial_cov_pos", "person", grid, n_boot)
    out = risk.summarise(r, GRID_REFERENCES, keys=("exposure",))
    cols = [f"{c}{e}" for c in ("risk", "risk_difference") for e in ("", "_conf_low", "_conf_high")]
    return out.select("exposure", "stratum", *[_r(c).alias(c) for c in cols], "n_boot_used", "n_failed")


def _fine_gray_sql(steps: int = 14) -> str:
    """Newton steps over pairwise risk sets (every event time with every subject), two covariates."""
    sql = """
, rec AS (SELECT (epoch_us(censor_time) - epoch_us(cohort_entry_time)) / 86400000000.0 AS t,
            CASE outcome WHEN 'censor' THEN 0 WHEN 'intubation' THEN 1 WHEN 'death' THEN 2 ELSE 3 END AS s,
            (abo = 'N')::DOUBLE AS x1, (abo = 'R')::DOUBLE AS x2
          FROM cr WHERE cohort_entry_time <= censor_time AND (dnr_date IS NULL OR dnr_date > censor_time) AND outcome IS NOT NULL)
, km AS (SELECT t, CASE WHEN c < n THEN ln(1 - c / n) ELSE -745.0 END AS lg FROM (
           SELECT c.t, c.c::DOUBLE AS c, (SELECT COUNT(*) FROM rec r WHERE r.t >= c.t)::DOUBLE AS n
           FROM (SELECT t, COUNT(*) AS c FROM rec WHERE s = 0 GROUP BY t) c) u)
, g AS (SELECT d.t, exp(coalesce(SUM(km.lg), 0)) AS g FROM (SELECT DISTINCT t FROM rec) d LEFT JOIN km ON km.t < d.t GROUP BY d.t)
, ev AS (SELECT t, COUNT(*)::DOUBLE AS d, SUM(x1) AS ex1, SUM(x2) AS ex2 FROM rec WHERE s = 1 GROUP BY t)
, pairs AS MATERIALIZED (SELECT ev.t, ev.d, r.x1, r.x2, CASE WHEN r.t >= ev.t THEN 1.0 ELSE ge.g / gr.g END AS w
           FROM ev JOIN rec r ON r.t >= ev.t OR r.s >= 2 JOIN g ge ON ge.t = ev.t JOIN g gr ON gr.t = r.t)
, step0 AS (SELECT 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"""
    sums = """(SELECT b1, b2, (SELECT SUM(ex1) FROM ev) - SUM(d * s1 / s0) AS u1, (SELECT SUM(ex2) FROM ev) - SUM(d * s2 / s0) AS u2,
      SUM(d * (s1 / s0 - s1 * s1 / (s0 * s0))) AS i11, SUM(d * (s2 / s0 - s2 * s2 / (s0 * s0))) AS i22, SUM(d * (0 - s1 * s2 / (s0 * s0))) AS i12, SUM(d / s0) AS lam
    FROM (SELECT b1, b2, t, ANY_VALUE(d) AS d, SUM(w * exp(x1 * b1 + x2 * b2)) AS s0, SUM(w * x1 * exp(x1 * b1 + x2 * b2)) AS s1,
                 SUM(w * x2 * exp(x1 * b1 + x2 * b2)) AS s2 FROM pairs, step{k} GROUP BY b1, b2, t) z GROUP BY b1, b2)"""
    for k in range(steps):
        sql += f"""
, step{k + 1} AS MATERIALIZED (SELECT b1 + (i22 * u1 - i12 * u2) / (i11 * i22 - i12 * i12) AS b1, b2 + (i11 * u2 - i12 * u1) / (i11 * i22 - i12 * i12) AS b2
    FROM {sums.replace('{k}', str(k))} y)"""
    return sql + f"""
, fin AS (SELECT *, i11 * i22 - i12 * i12 AS det FROM {sums.replace('{k}', str(steps))} y)
SELECT 'A' AS stratum, CAST(NULL AS DOUBLE) AS estimate, CAST(NULL AS DOUBLE) AS std_error, ROUND(1 - exp(-lam), 6) AS risk FROM fin
UNION ALL SELECT 'N', ROUND(b1, 6), ROUND(sqrt(i22 / det), 6), ROUND(1 - exp(-lam * exp(b1)), 6) FROM fin
UNION ALL SELECT 'R', ROUND(b2, 6), ROUND(sqrt(i11 / det), 6), ROUND(1 - exp(-lam * exp(b2)), 6) FROM fin"""


@register("fine_gray_unadjusted", with_ctes(["consistent", "tests"], COHORT_SQL + BASIC_SQL + CR_SQL + _fine_gray_sql()))
def fine_gray_unadjusted(spark, d):
    """Fine-Gray for intubation (death, recovery competing) on the ABO-analogue, coefficients and cumulative
    incidence at the last event time per stratum; the oracle takes the Newton steps over pairwise risk sets."""
    r = R.dummy(competing_records(spark, d, "intubation"), "abo", ["A", "N", "R"], drop=False, prefix="abo", sep="_")
    data = cut_lineage(r.select("survival_time", "status", "abo_N", "abo_R"))
    coefs, base, _ = survival.fine_gray(data, [], "survival_time", "status", ["abo_N", "abo_R"], max_iter=25, gtol=1e-18)
    at = spark.createDataFrame([("A", 0.0, 0.0), ("N", 1.0, 0.0), ("R", 0.0, 1.0)], "stratum string, abo_N double, abo_R double")
    risks = survival.predict_cif_last(at, coefs, base, ["abo_N", "abo_R"])
    got = coefs.select(F.substring("term", 5, 1).alias("stratum"), _r("estimate").alias("estimate"), _r("std_error").alias("std_error"))
    return risks.join(got, "stratum", "left").select("stratum", "estimate", "std_error", _r("pred").alias("risk"))


@register("risk_grid_bootstrap", None)
def risk_grid_bootstrap(spark, d, n_boot: int = 1000):
    """2 exposures x 2 adjustments x 3 outcomes x (apparent + n_boot) fits, batched by key;
    standardised risks, RD / NNT / RR with percentile intervals."""
    from . import risk
    prevalence, comp = _grid_inputs(spark, d)
    return risk.risk_grid(prevalence, comp, "person", GRID_EXPOSURES, GRID_STRATA, GRID_REFERENCES,
                          GRID_ADJUSTMENTS, n_boot=n_boot)


@register("baseline_table", None)
def baseline_table(spark, d):
    """Baseline characteristics by family (abo, rh, TOTAL): 'n (pct%)' cells."""
    from . import report
    return report.baseline_by_group(wide_table(spark, d), {"abo": ["abo"], "rh": ["rh"]},
                                    ["cov_pos", "intubated", "died"] + [f"rf_{f}" for f in FACTORS])


# ====================================================================== K4, K14, K15, D9/X2, D10, E3

STRAT_SQL = """
WITH tests AS (SELECT user_id AS person, MAX(CASE WHEN event_type = 'purchase' AND value >= 150.0 THEN 1 ELSE 0 END) AS cov_pos
               FROM events WHERE event_type NOT IN ('error') GROUP BY user_id),
base AS (SELECT c_custkey, t.cov_pos, CASE WHEN c_nationkey < 12 THEN 1 ELSE 0 END AS lt12, r_name, c_mktsegment
         FROM customer JOIN tests t ON c_custkey = t.person JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey),
long AS (SELECT 'region:' || r_name AS stratum, cov_pos, lt12 FROM base
         UNION ALL SELECT 'segment:' || c_mktsegment, cov_pos, lt12 FROM base),
g AS (SELECT stratum, lt12, CAST(SUM(cov_pos) AS DOUBLE) AS y, CAST(COUNT(*) AS DOUBLE) AS n FROM long GROUP BY ALL),
ref AS (SELECT stratum, y AS yr, n AS nr FROM g WHERE lt12 = 0),
coef AS (SELECT stratum, '(Intercept)' AS term, ln(yr / (nr - yr)) AS est, sqrt(1 / yr + 1 / (nr - yr)) AS se FROM ref
         UNION ALL SELECT g.stratum, 'nation_lt12', ln(y / (n - y)) - ln(yr / (nr - yr)),
                sqrt(1 / y + 1 / (n - y) + 1 / yr + 1 / (nr - yr)) FROM g JOIN ref USING (stratum) WHERE lt12 = 1)
SELECT stratum, term, ROUND(est, 5) AS estimate, ROUND(se, 5) AS std_error FROM coef"""


@register("stratified_logit_strata", STRAT_SQL)
def stratified_logit_strata(spark, d):
    """One logistic model per subgroup; the subgroup columns (region, segment) are
    unpivoted and united into one stratum key, all strata fitted by one batched IRLS."""
    ct = D.customers_tested(spark, d)
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = ct.join(F.broadcast(geo), ct.c_nationkey == geo.n_nationkey) \
        .withColumn("nation_lt12", (F.col("c_nationkey") < 12).cast("double")) \
        .withColumn("nation_ge12", (F.col("c_nationkey") >= 12).cast("double")) \
        .withColumnRenamed("r_name", "region").withColumnRenamed("c_mktsegment", "segment")
    long = R.lengthen(base.select("person", "cov_pos", "nation_lt12", "nation_ge12", "region", "segment"),
                      ["person", "cov_pos", "nation_lt12", "nation_ge12"], ["region", "segment"], "stype", "svalue")
    long = R.unite(long, "stratum", ["stype", "svalue"], sep=":")
    coefs, _ = glm.logit_grouped(long, ["stratum"], "cov_pos", ["nation_lt12", "nation_ge12"], epsilon=1e-14)
    return coefs.select("stratum", "term", _r("estimate", 5).alias("estimate"), _r("std_error", 5).alias("std_error"))


@register("compare_coefs_segment", None)
def compare_coefs_segment(spark, d):
    """Full (segment + balance class) vs nested (segment) model, estimate and p side by side."""
    ct = _logit_input(spark, d).withColumn("acct_high", (F.col("c_acctbal") > 5000).cast("double"))
    grid, terms = glm.model_grid(ct, {"cov_pos": ("cov_pos", None)},
                                 {"nested": SEG_TERMS, "full": SEG_TERMS + ["acct_high"]})
    coefs, _ = glm.logit_grouped(grid, ["outcome", "model"], "__y_val", terms)
    return glm.compare_coefs(coefs.filter("model = 'full'").drop("model"),
                             coefs.filter("model = 'nested'").drop("model"))


@register("chisq_sites_regions", """
WITH cnt AS (SELECT c_mktsegment AS "group", r_name AS arm, COUNT(*) AS n FROM customer
             JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
             WHERE r_name IN ('AFRICA', 'AMERICA') GROUP BY ALL),
cfg AS (SELECT * FROM (VALUES ('AFRICA_vs_AMERICA', 'AFRICA', 0), ('AFRICA_vs_AMERICA', 'AMERICA', 1)) t(comparison, arm, col_idx)),
j AS (SELECT comparison, "group", col_idx, CAST(n AS DOUBLE) AS o FROM cnt JOIN cfg USING (arm)),
e AS (SELECT *, SUM(o) OVER (PARTITION BY comparison, "group") * SUM(o) OVER (PARTITION BY comparison, col_idx)
             / SUM(o) OVER (PARTITION BY comparison) AS ex FROM j),
s AS (SELECT comparison, SUM(pow(o - ex, 2) / ex) AS x,
        CAST((COUNT(DISTINCT "group") - 1) * (COUNT(DISTINCT col_idx) - 1) AS INTEGER) AS parameter FROM e GROUP BY ALL),
p AS (SELECT *, """ + D.sql_chi2_sf("x", "parameter") + """ AS pv,
         (parameter / 2.0 - 1) * ln(x) - x / 2 - (parameter / 2.0) * ln(2) - lgamma(parameter / 2.0) AS ld FROM s)
SELECT comparison, ROUND(x, 6) AS statistic, parameter, ROUND(pv, 8) AS p_value, ROUND(ld, 6) AS log_density,
  CAST(floor(ld / ln(10)) AS BIGINT) AS density_exponent,
  ROUND(round_even(exp(ld - floor(ld / ln(10)) * ln(10)), 1), 1) AS density_mantissa
FROM p""")
def chisq_sites_regions(spark, d):
    """Homogeneity of the segment distribution between two sites; chi-squared log density as
    mantissa/exponent (the reference's tiny-p print)."""
    c = table(spark, d, "customer")
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey).filter(F.col("r_name").isin("AFRICA", "AMERICA"))
    cnt = j.groupBy(F.col("c_mktsegment").alias("group"), F.col("r_name").alias("site")).agg(F.count(F.lit(1)).alias("n"))
    r = K.chisq_sites(cnt, "AFRICA", "AMERICA")
    return r.select("comparison", _r("statistic").alias("statistic"), "parameter", _r("p_value", 8).alias("p_value"),
                    _r("log_density").alias("log_density"), "density_exponent", "density_mantissa")


@register("overall_summary_events", """
SELECT characteristic, statistic, ROUND(value, 6) AS value, n_persons FROM (
  SELECT 'value' AS characteristic, 'mean' AS statistic, AVG(value) AS value, COUNT(*) AS n_persons FROM events
  UNION ALL SELECT 'value', 'median', quantile_cont(value, 0.5), COUNT(*) FROM events
  UNION ALL SELECT 'value', 'q1', quantile_cont(value, 0.25), COUNT(*) FROM events
  UNION ALL SELECT 'value', 'q3', quantile_cont(value, 0.75), COUNT(*) FROM events
  UNION ALL SELECT 'purchase', 'share', AVG(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), COUNT(*) FROM events) u""")
def overall_summary_events(spark, d):
    """Mean, exact median and quartiles (linear interpolation), share of a flag; long form."""
    from . import report
    ev = table(spark, d, "events").withColumn("purchase", (F.col("event_type") == "purchase").cast("int"))
    s = report.baseline_overall(ev, ["value"], ["purchase"])
    return s.select("characteristic", "statistic", _r("value").alias("value"), "n_persons")


@register("zscore_acctbal", """
SELECT c_custkey, ROUND((c_acctbal - AVG(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 8) AS c_acctbal_z
FROM customer""")
def zscore_acctbal(spark, d):
    """Z-score via a one-row aggregate broadcast back (no single-task global window)."""
    z = A.zscore(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    return z.select("c_custkey", _r("c_acctbal_z", 8).alias("c_acctbal_z"))


@register("partition_counts_orders", """
SELECT o_orderkey, o_custkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n_in_group,
       d.n_status FROM orders JOIN (SELECT o_custkey AS ck, COUNT(DISTINCT o_orderstatus) AS n_status FROM orders
       GROUP BY o_custkey) d ON o_custkey = d.ck""")
def partition_counts_orders(spark, d):
    """Partition count and distinct count kept on each row (aggregate + join back, skew-safe)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    o = A.partition_summary(o, ["o_custkey"], n_in_group=F.count(F.lit(1)), n_status=F.count_distinct("o_orderstatus"))
    return o.select("o_orderkey", "o_custkey", "n_in_group", "n_status")


MISSING_SQL = """
WITH o AS (SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS x,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END AS y FROM orders),
n AS (SELECT COUNT(*) FILTER (WHERE y IS NULL) AS n_dropped, COUNT(y) AS n_used FROM o),
c AS (SELECT SUM(y) FILTER (WHERE x = 1) AS a, SUM(1 - y) FILTER (WHERE x = 1) AS b,
             SUM(y) FILTER (WHERE x = 0) AS c, SUM(1 - y) FILTER (WHERE x = 0) AS d FROM o WHERE y IS NOT NULL)"""


def _missing_outcome(spark, d):
    """Orders: y = expensive, unknown for one priority; x = finished."""
    return table(spark, d, "orders").select(
        (F.col("o_orderstatus") == "F").cast("double").alias("x"),
        F.when(F.col("o_orderpriority") != "5-LOW", (F.col("o_totalprice") > 150000).cast("double")).alias("y"))


def _with_counts(coefs, df):
    return coefs.crossJoin(F.broadcast(glm.dropped_cases(df, [], ["y", "x"]))).select(
        "term", _r("estimate", 6).alias("estimate"), "n_used", "n_dropped")


@register("logit_missing_outcome", MISSING_SQL + """
SELECT u.term, ROUND(u.estimate, 6) AS estimate, CAST(n_used AS BIGINT) AS n_used, CAST(n_dropped AS BIGINT) AS n_dropped
FROM n, (SELECT '(Intercept)' AS term, ln(c / d) AS estimate FROM c UNION ALL SELECT 'x', ln(a * d / (b * c)) FROM c) u""")
def logit_missing_outcome(spark, d):
    """K6: fitted on complete rows; rows with a missing outcome are counted, not treated as non-events."""
    df = _missing_outcome(spark, d)
    return _with_counts(glm.logit(df, "y", ["x"])[0], df)


@register("ols_missing_outcome", MISSING_SQL + """
SELECT u.term, ROUND(u.estimate, 6) AS estimate, CAST(n_used AS BIGINT) AS n_used, CAST(n_dropped AS BIGINT) AS n_dropped
FROM n, (SELECT '(Intercept)' AS term, c / (c + d) AS estimate FROM c UNION ALL SELECT 'x', a / (a + b) - c / (c + d) FROM c) u""")
def ols_missing_outcome(spark, d):
    """The linear model on complete rows."""
    df = _missing_outcome(spark, d)
    return _with_counts(glm.ols_grouped(df, [], "y", ["x"])[0], df)


@register("chisq_types_nations", """
WITH o AS (SELECT p_type AS r, s_nationkey AS c, COUNT(*) * 1.0 AS o FROM lineitem JOIN part ON l_partkey = p_partkey
           JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
rt AS (SELECT r, SUM(o) AS rt FROM o GROUP BY r), ct AS (SELECT c, SUM(o) AS ct FROM o GROUP BY c),
t AS (SELECT SUM(rt) AS n, COUNT(*) AS nr FROM rt), k AS (SELECT COUNT(*) AS nc FROM ct),
s AS (SELECT SUM((COALESCE(o, 0) - rt * ct / n) ** 2 / (rt * ct / n)) AS statistic, MAX((nr - 1) * (nc - 1)) AS parameter
      FROM rt CROSS JOIN ct CROSS JOIN t CROSS JOIN k LEFT JOIN o ON o.r = rt.r AND o.c = ct.c),
e AS (SELECT SUM(exp(-statistic / 2 + j * ln(statistic / 2) - lgamma(j + 1))) AS p
      FROM s, generate_series(0, 100000) g(j) WHERE j < parameter / 2)
SELECT ROUND(statistic, 4) AS statistic, CAST(parameter AS INTEGER) AS parameter, parameter > 1500 AND p > 0 AND p <= 1 AS tail_defined,
       ROUND(CASE WHEN parameter % 2 = 0 THEN p END, 6) AS p_value FROM s, e""")
def chisq_types_nations(spark, d):
    """K3: part type x supplier nation: thousands of degrees of freedom, zero cells, no grid."""
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")) \
        .join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    r = K.chisq_crosstab(j, "p_type", "s_nationkey")
    p = F.col("p_value")
    return r.select(_r("statistic", 4).alias("statistic"), "parameter", ((F.col("parameter") > 1500) & (p > 0) & (p <= 1)).alias("tail_defined"),
                    F.when(F.col("parameter") % 2 == 0, _r("p_value")).alias("p_value"))


@register("price_quantiles_by_segment", """
SELECT c_mktsegment, COUNT(*) AS n, ROUND(quantile_cont(o_totalprice, 0.25), 4) AS q1, ROUND(median(o_totalprice), 4) AS median,
  ROUND(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def price_quantiles_by_segment(spark, d):
    """Exact median and quartiles by group from distributed order statistics."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    q = A.quantiles(o, ["c_mktsegment"], ["o_totalprice"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    wide = q.groupBy("c_mktsegment").agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("statistic") == s, F.col("value"))).alias(s) for s in ("q1", "median", "q3")])
    return wide.select("c_mktsegment", "n", *[_r(s, 4).alias(s) for s in ("q1", "median", "q3")])


@register("qc_wide_table", with_ctes(["tested", "closure"], "," + RISK_SQL + """
, flags AS (SELECT person, """ + ", ".join(f"MAX(CASE WHEN factor = '{f}' THEN 1 ELSE 0 END) AS rf_{f}" for f in FACTORS)
                                   + """ FROM rf GROUP BY person)
, w AS (SELECT t.person, c_mktsegment, t.abo, t.rh, t.cov_pos, COALESCE(t.intubated, 0) AS intubated,
       COALESCE(t.died, 0) AS died, """ + ", ".join(f"COALESCE(rf_{f}, 0) AS rf_{f}" for f in FACTORS) + """
FROM tested t JOIN customer ON t.person = c_custkey LEFT JOIN flags f ON t.person = f.person
WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') AND t.person >= 0)
SELECT 'rows' AS "check", COUNT(*) AS n FROM w
UNION ALL SELECT 'distinct_keys', COUNT(DISTINCT person) FROM w
UNION ALL SELECT 'duplicate_keys', COUNT(*) - COUNT(DISTINCT person) FROM w
UNION ALL SELECT 'implausible:intubated_not_positive', COUNT(*) FILTER (WHERE intubated = 1 AND cov_pos = 0) FROM w
UNION ALL SELECT 'implausible:died_not_positive', COUNT(*) FILTER (WHERE died = 1 AND cov_pos = 0) FROM w
""" + "".join(f"UNION ALL SELECT 'null:{c}', COUNT(*) FILTER (WHERE {c} IS NULL) FROM w\n" for c in
              ["person", "c_mktsegment", "abo", "rh", "cov_pos", "intubated", "died"] + [f"rf_{f}" for f in FACTORS])))
def qc_wide_table(spark, d):
    """One-pass QC of the wide table: key uniqueness, NULLs per column, implausible combinations."""
    from . import report
    return report.qc_report(wide_table(spark, d), "person",
                            {"intubated_not_positive": "intubated = 1 AND cov_pos = 0",
                             "died_not_positive": "died = 1 AND cov_pos = 0"})


# ---------------------------------------------------------------- sources, scalars and shapes on whole tables

@register("versioned_customers", """
SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'""")
def versioned_customers(spark, d):
    """A4/A5: two appended versions of an analysis table; the second is read back."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    path = scratch_path(spark, f"versions-{uuid.uuid4().hex[:8]}")
    io.append_version(c, path, "2020-04-12", "all")
    io.append_version(c.filter("c_mktsegment = 'BUILDING'"), path, "2020-04-18", "building")
    return io.read_version(spark, path, "2020-04-18", "building").select("c_custkey", "c_mktsegment")


@register("snapshot_one_day", """
SELECT o_orderstatus, COUNT(*) AS n FROM orders
WHERE CAST(o_orderdate AS DATE) = (SELECT CAST(MAX(o_orderdate) AS DATE) FROM orders) GROUP BY o_orderstatus""")
def snapshot_one_day(spark, d):
    """A2: rows of exactly one retrieval date (here the last order date)."""
    o = table(spark, d, "orders").withColumn("date_retrieved", F.to_date("o_orderdate"))
    last = o.agg(F.max("date_retrieved")).first()[0]
    return io.snapshot(o, last).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("tsv_bundle_roundtrip", """
SELECT c_custkey, c_name, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer""")
def tsv_bundle_roundtrip(spark, d):
    """A bundle of tab-separated tables with NA, read back typed."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("nation"))
    path = scratch_path(spark, f"bundle-{uuid.uuid4().hex[:8]}")
    io.write_bundle({"customer": c, "region": table(spark, d, "region")}, path)
    types = dict(c.dtypes)
    return io.read_tsv(spark, f"{path}/customer", ", ".join(f"{k} {types[k]}" for k in c.columns))


@register("sql_template", """
SELECT o_orderpriority, w.weight, COUNT(*) AS n FROM orders JOIN (VALUES ('F', 2), ('O', 1)) w(status, weight)
ON o_orderstatus = w.status WHERE o_totalprice >= 100000 GROUP BY o_orderpriority, w.weight""")
def sql_template(spark, d):
    """A literal table joined in a parameterised SQL text."""
    table(spark, d, "orders").createOrReplaceTempView("orders_for_template")
    io.literal_table(spark, [("F", 2), ("O", 1)], "status string, weight int").createOrReplaceTempView("weights_for_template")
    return io.run_sql(spark, "SELECT o_orderpriority, weight, COUNT(*) AS n FROM IDENTIFIER(:orders) JOIN weights_for_template "
                             "ON o_orderstatus = status WHERE o_totalprice >= :least GROUP BY o_orderpriority, weight",
                      {"orders": "orders_for_template", "least": 100000})


@register("text_scalars", """
SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^[A-Z]+ P[A-Z]+') THEN regexp_extract(p_type, '^[A-Z]+ P[A-Z]+') END AS extracted,
  upper(p_type[1]) || lower(p_type[2:]) AS sentence, trim(regexp_replace('  ' || p_name || '   x ', '\\s+', ' ', 'g')) AS squished,
  CASE WHEN p_brand = 'Brand#11' THEN NULL ELSE p_brand END AS brand, CAST(p_partkey AS BIGINT) AS code FROM part""")
def text_scalars(spark, d):
    """Extract or NULL, sentence case, check digit, squish, missing tokens."""
    return table(spark, d, "part").select(
        "p_partkey", X.extract_or_null("p_type", "^[A-Z]+ P[A-Z]+").alias("extracted"), X.sentence_case("p_type").alias("sentence"),
        X.squish(F.concat(F.lit("  "), "p_name", F.lit("   x "))).alias("squished"), X.null_tokens("p_brand", ("Brand#11",)).alias("brand"),
        X.drop_check_digit(F.concat(F.col("p_partkey").cast("string"), F.lit("-"), (F.col("p_partkey") % 10).cast("string"))).cast("long").alias("code"))


@register("number_formats", """
SELECT c_custkey, printf('%.6g', c_acctbal) AS general, printf('%.1f', c_acctbal) AS fixed FROM customer""")
def number_formats(spark, d):
    """Significant-digit and fixed formatting."""
    return table(spark, d, "customer").select("c_custkey", fmt.fmt_g("c_acctbal", 6).alias("general"), fmt.fmt_fixed("c_acctbal", 1).alias("fixed"))


@register("nested_nations", """SELECT n_regionkey, n_nationkey, n_name FROM nation""")
def nested_nations(spark, d):
    """Rows nested per region (a bounded group) and unnested again."""
    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name")
    return R.unnest(R.nest(n, ["n_regionkey"])).select("n_regionkey", "n_nationkey", "n_name")


@register("transposed_status", """
SELECT 'n' AS name, CAST(COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS VARCHAR) AS F, CAST(COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS VARCHAR) AS O,
       CAST(COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS VARCHAR) AS P FROM orders""")
def transposed_status(spark, d):
    """A small summary turned round; its columns are declared levels, so nothing is collected."""
    s = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return R.transpose(s, "o_orderstatus", ["F", "O", "P"])


@register("top_customers_by_level", """
SELECT c_custkey, c_mktsegment, c_acctbal FROM customer
ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, c_acctbal DESC, c_custkey LIMIT 25""")
def top_customers_by_level(spark, d):
    """Sort by a declared level order, then balance; the first rows of the report."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return R.order_by_levels(c, "c_mktsegment", ["MACHINERY", "BUILDING"], extra=[F.desc("c_acctbal"), "c_custkey"]).limit(25)


def queries():
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql():
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


from . import tables  # noqa: E402,F401  registers its queries
