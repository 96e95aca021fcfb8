"""Clinical roles mapped onto the driver tables as reusable Spark plans.

Role mapping (all derived from the given tables, whole tables read):

* person                 customer.c_custkey (= events.user_id)
* vocabulary closure     part: (p_type -> p_partkey) and (p_brand -> p_partkey)
* typed measurement      lineitem x orders, code l_partkey, text "l_returnflag l_linestatus",
                         person o_custkey; blood-type analogue = codes under ancestor 'Brand#1'
* tests                  events: 'error' is an invalid result, a 'purchase' with value >= 150 is positive
* outcome events         events: 'signup' with value >= 150 ("intubation"), 'click' with value >= 200 ("death")
* encounters             events 'view' at ts, lasting 48 h
* sites                  region (via nation)

Every function takes ``(spark, sf_dir)`` and returns a lazy DataFrame.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import recode
from ..operators import relational as rel

TYPE_ANCESTOR = "Brand#1"
POSITIVE_VALUE = 150.0
INVALID_RESULTS = ["error"]
ABO_RULES = [("A %", "A"), ("N %", "N"), ("R %", "R")]
RH_RULES = [(["% O"], "pos"), (["% F"], "neg")]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(d, f"{name}.parquet"))


def part_closure(spark: SparkSession, d: str) -> DataFrame:
    """Two-level vocabulary closure (ancestor, descendant) built from part."""
    p = table(spark, d, "part")
    return rel.union_all([
        p.select(F.col("p_type").alias("ancestor"), F.col("p_partkey").alias("descendant")),
        p.select(F.col("p_brand").alias("ancestor"), F.col("p_partkey").alias("descendant")),
    ])


def typed_measurements(spark: SparkSession, d: str, ancestor: str = TYPE_ANCESTOR) -> DataFrame:
    """Typed text of every measurement whose code descends from ``ancestor``."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    m = rel.descendants(li, "l_partkey", part_closure(spark, d), [ancestor], anc_col="ancestor",
                        desc_col="descendant")
    return m.join(o, m.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("person"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("type_text")).distinct()


def parse_type(df: DataFrame, text: str = "type_text") -> DataFrame:
    """Ordered LIKE recodes into two categories."""
    return df.select("person", recode(text, ABO_RULES, kind="like").alias("abo"),
                     recode(text, RH_RULES, kind="like").alias("rh")).distinct()


def typed(spark: SparkSession, d: str) -> DataFrame:
    return parse_type(typed_measurements(spark, d))


def consistent_types(spark: SparkSession, d: str) -> DataFrame:
    """J3 (distinct_non_null policy)."""
    return rel.keep_consistent(typed(spark, d), "person", ["abo", "rh"], "distinct_non_null")


def person_events(spark: SparkSession, d: str) -> DataFrame:
    """ONE aggregate over events per person: valid tests, ever positive, outcome flags.

    Test results, outcome flags and the set of persons with any event all derive from this frame, so a
    plan that needs several of them shares one scan + exchange (identical subplans are reused).
    """
    ev = table(spark, d, "events")
    valid = ~F.col("event_type").isin(INVALID_RESULTS)
    pos = valid & (F.col("event_type") == "purchase") & (F.col("value") >= POSITIVE_VALUE)
    return ev.groupBy(F.col("user_id").alias("person")).agg(
        F.max(pos.cast("int")).alias("cov_pos"), F.count_if(valid).alias("n_tests"),
        F.max(((F.col("event_type") == "signup") & (F.col("value") >= POSITIVE_VALUE)).cast("int")).alias("intubated"),
        F.max(((F.col("event_type") == "click") & (F.col("value") >= 200.0)).cast("int")).alias("died"))


def test_results(spark: SparkSession, d: str) -> DataFrame:
    """Valid tests per person, ever positive (persons with only invalid results are untested)."""
    return person_events(spark, d).filter(F.col("n_tests") > 0).select("person", "cov_pos", "n_tests")


def outcome_flags(spark: SparkSession, d: str) -> DataFrame:
    """'intubated' / 'died' analogues per person."""
    return person_events(spark, d).select("person", "intubated", "died")


def tested_persons(spark: SparkSession, d: str, cons: DataFrame | None = None) -> DataFrame:
    """Consistently typed, tested persons with outcome flags (one row per person, one events aggregate)."""
    cons = cons if cons is not None else consistent_types(spark, d)
    return cons.join(person_events(spark, d).filter(F.col("n_tests") > 0), "person")


def general_population(spark: SparkSession, d: str, cons: DataFrame | None = None) -> DataFrame:
    """Typed persons never tested (anti join on all event users)."""
    users = person_events(spark, d).select("person")
    cons = cons if cons is not None else consistent_types(spark, d)
    return rel.anti(cons, users, "person")


def customers_tested(spark: SparkSession, d: str) -> DataFrame:
    """customer x test results (segment as the grouping)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), "c_mktsegment", "c_nationkey",
                                          "c_acctbal")
    return c.join(test_results(spark, d), "person")


# ---------------------------------------------------------------- SQL fragments for the DuckDB oracle

SQL_CTE = {
    "closure": "closure AS (SELECT p_type AS ancestor, p_partkey AS descendant FROM part "
               "UNION ALL SELECT p_brand, p_partkey FROM part)",
    "meas": "meas AS (SELECT DISTINCT o_custkey AS person, l_returnflag || ' ' || l_linestatus AS type_text "
            "FROM lineitem JOIN closure ON l_partkey = descendant JOIN orders ON l_orderkey = o_orderkey "
            f"WHERE ancestor = '{TYPE_ANCESTOR}')",
    "typed": "typed AS (SELECT DISTINCT person, CASE WHEN type_text LIKE 'A %' THEN 'A' "
             "WHEN type_text LIKE 'N %' THEN 'N' WHEN type_text LIKE 'R %' THEN 'R' END AS abo, "
             "CASE WHEN type_text LIKE '% O' THEN 'pos' WHEN type_text LIKE '% F' THEN 'neg' END AS rh FROM meas)",
    "consistent": "consistent AS (SELECT * FROM typed WHERE person IN (SELECT person FROM typed GROUP BY person "
                  "HAVING COUNT(DISTINCT CASE WHEN abo IS NOT NULL AND rh IS NOT NULL THEN abo || '|' || rh END) = 1))",
    "tests": "tests AS (SELECT user_id AS person, MAX(CASE WHEN event_type = 'purchase' AND value >= "
             f"{POSITIVE_VALUE} THEN 1 ELSE 0 END) AS cov_pos, COUNT(*) AS n_tests FROM events "
             "WHERE event_type NOT IN ('error') GROUP BY user_id)",
    "outcomes": "outcomes AS (SELECT user_id AS person, "
                f"MAX(CASE WHEN event_type = 'signup' AND value >= {POSITIVE_VALUE} THEN 1 ELSE 0 END) AS intubated, "
                "MAX(CASE WHEN event_type = 'click' AND value >= 200.0 THEN 1 ELSE 0 END) AS died "
                "FROM events GROUP BY user_id)",
    "tested": "tested AS (SELECT c.person, c.abo, c.rh, t.cov_pos, t.n_tests, o.intubated, o.died "
              "FROM consistent c JOIN tests t ON c.person = t.person LEFT JOIN outcomes o ON c.person = o.person)",
    "general": "general AS (SELECT * FROM consistent WHERE person NOT IN (SELECT user_id FROM events))",
    "ctested": "ctested AS (SELECT c_custkey AS person, c_mktsegment, c_nationkey, c_acctbal, t.cov_pos, t.n_tests "
               "FROM customer JOIN tests t ON c_custkey = t.person)",
}
_ORDER = ["closure", "meas", "typed", "consistent", "tests", "outcomes", "tested", "general", "ctested"]
_DEPS = {"meas": ["closure"], "typed": ["meas"], "consistent": ["typed"], "tested": ["consistent", "tests", "outcomes"],
         "general": ["consistent"], "ctested": ["tests"]}


def with_ctes(names: list[str], body: str) -> str:
    need = set()

    def add(n):
        if n in need:
            return
        need.add(n)
        for dep in _DEPS.get(n, []):
            add(dep)

    for n in names:
        add(n)
    ctes = [SQL_CTE[n] for n in _ORDER if n in need]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


# ---------------------------------------------------------------- SQL expressions for the oracle only

def sql_erfc(z: str) -> str:
    """DuckDB expression for erfc(z), z >= 0 (series below 1.5, continued fraction above)."""
    series = (f"(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: "
              f"pow(-1, n) * pow({z}, 2 * n + 1) / (exp(lgamma(n + 1)) * (2 * n + 1)))))")
    cf = (f"(exp(-({z}) * ({z})) / sqrt(pi()) / list_reduce(list_transform(range(100, 0, -1), lambda n: n / 2.0), "
          f"lambda acc, h: ({z}) + h / acc, CAST({z} AS DOUBLE)))")
    return f"(CASE WHEN ({z}) < 1.5 THEN {series} ELSE {cf} END)"


def sql_chi2_sf(x: str, df: str) -> str:
    """DuckDB expression for the chi-squared upper tail with integer df."""
    y = f"(({x}) / 2.0)"
    even = (f"list_sum(list_transform(range(0, CAST(({df}) / 2 AS BIGINT)), lambda j: "
            f"exp(j * ln({y}) - {y} - lgamma(j + 1))))")
    odd = (f"({sql_erfc(f'sqrt({y})')} + coalesce(list_sum(list_transform(range(0, CAST((({df}) - 1) / 2 AS BIGINT)), "
           f"lambda j: exp((j + 0.5) * ln({y}) - {y} - lgamma(j + 1.5)))), 0))")
    return f"(CASE WHEN ({x}) <= 0 THEN 1.0 WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)"


def sql_norm_p(z: str) -> str:
    """DuckDB two-sided normal p-value for a z statistic."""
    return sql_erfc(f"(abs({z}) / sqrt(2.0))")
