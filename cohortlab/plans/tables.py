"""Registered queries for the published tables and the operators behind them, with oracle SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X, fmt
from ..operators import agg as A
from ..operators import contingency as K
from ..operators import glm, meta, relational as rel, reshape as R
from . import catalog as C
from . import driver as D
from . import report
from .catalog import _r, register
from .driver import table, with_ctes

FLAGS = ["cov_pos", "intubated", "died", *(f"rf_{f}" for f in C.FACTORS)]
FAMILIES = {"abo": ["abo"], "rh": ["rh"], "abo_rh": ["abo", "rh"]}
CONDITIONAL = {"intubated_cov_pos": ("intubated", "cov_pos"), "died_cov_pos": ("died", "cov_pos")}


# ====================================================================== X1, X3: baseline tables

_WIDE = f"wide AS ({C.REGISTRY['wide_table'][1]})"

C.REGISTRY["baseline_table"] = (C.REGISTRY["baseline_table"][0], f"""
WITH {_WIDE}
, fam AS (SELECT 'abo' AS family, abo AS "group", * FROM wide UNION ALL SELECT 'rh', rh, * FROM wide UNION ALL SELECT 'TOTAL', 'TOTAL', * FROM wide)
, sums AS (SELECT family, "group", COUNT(*) AS n_persons, {", ".join(f'SUM({f})::BIGINT AS {f}' for f in FLAGS)} FROM fam GROUP BY family, "group")
, long AS (UNPIVOT sums ON {", ".join(FLAGS)} INTO NAME characteristic VALUE n)
SELECT family, "group", n_persons, characteristic, n, 100.0::DOUBLE * n / n_persons AS pct,
  n || ' (' || printf('%.1f', 100.0::DOUBLE * n / n_persons) || ')' AS cell FROM long""")

_FAMILY_SQL = """
, fam AS (SELECT 'abo' AS family, abo AS "group", * FROM base UNION ALL SELECT 'rh', rh, * FROM base
          UNION ALL SELECT 'abo_rh', abo || '-' || rh, * FROM base UNION ALL SELECT 'TOTAL', 'TOTAL', * FROM base)"""


@register("baseline_full", f"""
WITH {_WIDE}
, base AS (SELECT w.*, ROUND(c_acctbal / 100.0, 6) AS age FROM wide w JOIN customer c ON w.person = c.c_custkey)
{_FAMILY_SQL}
, sums AS (SELECT family, "group", COUNT(*) AS n_all, {", ".join(f'SUM({f})::BIGINT AS {f}' for f in FLAGS)},
    SUM(intubated * cov_pos)::BIGINT AS intubated_cov_pos, SUM(died * cov_pos)::BIGINT AS died_cov_pos, AVG(age) AS mean,
    quantile_cont(age, 0.5) AS median, quantile_cont(age, 0.25) AS q1, quantile_cont(age, 0.75) AS q3 FROM fam GROUP BY family, "group")
, u AS (SELECT family, "group", 'N' AS characteristic, n_all AS n, SUM(n_all) OVER (PARTITION BY family)::BIGINT AS of FROM sums
  {" ".join(f"UNION ALL SELECT family, " + chr(34) + "group" + chr(34) + f", '{f}', {f}, n_all FROM sums" for f in FLAGS)}
  {" ".join(f"UNION ALL SELECT family, " + chr(34) + "group" + chr(34) + f", '{c}', {c}, cov_pos FROM sums" for c in CONDITIONAL)})
SELECT family, "group", characteristic, n, of, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS q1,
  CAST(NULL AS DOUBLE) AS q3, n || ' (' || CASE WHEN of = 0 THEN 'NaN' ELSE printf('%.1f', 100.0::DOUBLE * n / of) END || ')' AS cell FROM u
UNION ALL SELECT family, "group", 'age', n_all, n_all, ROUND(mean, 6), ROUND(median, 6), ROUND(q1, 6), ROUND(q3, 6),
  printf('%.0f', median) || ' (' || printf('%.0f', q1) || '-' || printf('%.0f', q3) || ')' FROM sums""")
def baseline_full(spark, d):
    """Baseline by ABO-, Rh-, joint analogue and TOTAL: shares, flags, outcomes among positives, age quartiles."""
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), _r(F.col("c_acctbal") / 100.0).alias("age"))
    base = C.wide_table(spark, d).join(cust, "person")
    out = report.baseline_full(base, FAMILIES, ["age"], FLAGS, CONDITIONAL)
    return out.select("family", "group", "characteristic", "n", "of", *[_r(c).alias(c) for c in ("mean", "median", "q1", "q3")], "cell")


# ====================================================================== X4, D13: test tables with count texts

@register("test_count_table", with_ctes(["tested", "general"], C.CONT_SQL + """
, t AS (SELECT *, SUM(n) OVER (PARTITION BY family, arm) AS tot FROM cont WHERE arm IN ('covid_positive', 'covid_negative', 'general_pop'))
, txt AS (SELECT family, arm, string_agg("group" || ':' || n || ' (' || regexp_replace(printf('%.1f', 100.0::DOUBLE * n / tot), '\\.0$', '') || '%)',
            ', ' ORDER BY "group") AS s FROM t WHERE "group" IS NOT NULL GROUP BY family, arm)
SELECT a.family, c.comparison, a.s AS group_1_counts, b.s AS group_2_counts
FROM (VALUES ('positive_vs_general', 'covid_positive', 'general_pop'), ('positive_vs_negative', 'covid_positive', 'covid_negative')) c(comparison, a1, a2)
JOIN txt a ON a.arm = c.a1 JOIN txt b ON b.family = a.family AND b.arm = c.a2"""))
def test_count_table(spark, d):
    """The counts of both arms of each chi-squared test as ordered texts (group:n (pct%))."""
    cont = C.typed_contingency(spark, d)
    tests = K.chisq(cont, C.COMPARISONS, keys=["family"])
    out = report.test_count_table(tests, cont, C.COMPARISONS)
    return out.select("family", "comparison", "group_1_counts", "group_2_counts")


@register("order_line_texts", """
SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ', ' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS statuses,
  COUNT(*) AS n_lines FROM lineitem GROUP BY l_orderkey""")
def order_line_texts(spark, d):
    """D13 on a growing table: the line statuses of every order in line order, repeats kept."""
    li = table(spark, d, "lineitem").withColumn("status", F.concat("l_returnflag", "l_linestatus"))
    texts = A.join_text(li, ["l_orderkey"], "status", order="l_linenumber", out="statuses")
    return texts.join(li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines")), "l_orderkey")


# ====================================================================== X6, K7, K14: models

_GROUPS = ["A", "N", "R", "neg", "pos"]


@register("group_on_risk_factor", with_ctes(["consistent"], """
, p AS (SELECT c.*, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END AS male FROM consistent c JOIN customer ON person = c_custkey
        WHERE abo IS NOT NULL AND rh IS NOT NULL)
, g AS (""" + " UNION ALL ".join(
    f"SELECT '{v}' AS blood_group, male, SUM(({'abo' if v in 'ANR' else 'rh'} = '{v}')::INT)::DOUBLE AS y, COUNT(*)::DOUBLE AS n FROM p GROUP BY male" for v in _GROUPS) + """)
, f AS (SELECT a.blood_group, ln(a.y / (a.n - a.y)) AS b0, ln(b.y / (b.n - b.y)) - ln(a.y / (a.n - a.y)) AS b1,
          sqrt(1 / a.y + 1 / (a.n - a.y)) AS s0, sqrt(1 / b.y + 1 / (b.n - b.y) + 1 / a.y + 1 / (a.n - a.y)) AS s1
        FROM g a JOIN g b ON a.blood_group = b.blood_group AND a.male = 0 AND b.male = 1)
SELECT blood_group, '(Intercept)' AS term, ROUND(b0, 5) AS estimate, ROUND(s0, 5) AS std_error, ROUND(""" + D.sql_norm_p("b0 / s0") + """, 7) AS p_value FROM f
UNION ALL SELECT blood_group, 'male', ROUND(b1, 5), ROUND(s1, 5), ROUND(""" + D.sql_norm_p("b1 / s1") + """, 7) FROM f"""))
def group_on_risk_factor(spark, d):
    """Every blood-group level regressed on a covariate, all levels from one pattern table (saturated, so the
    oracle is closed form)."""
    male = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), (F.col("c_mktsegment") == "MACHINERY").cast("double").alias("male"))
    p = D.consistent_types(spark, d).filter("abo is not null and rh is not null").join(male, "person")
    for v in _GROUPS:
        p = p.withColumn(v, (F.col("abo" if v in "ANR" else "rh") == v).cast("double"))
    coefs, _ = glm.logit_responses(p, _GROUPS, ["male"], name="blood_group", epsilon=1e-14)
    return coefs.select("blood_group", "term", _r("estimate", 5).alias("estimate"), _r("std_error", 5).alias("std_error"), _r("p_value", 7).alias("p_value"))


@register("compare_coefs_saturated", with_ctes(["ctested"], """
, g AS (SELECT (c_acctbal > 5000)::INT AS hi, SUM(cov_pos)::DOUBLE AS y, COUNT(*)::DOUBLE AS n FROM ctested GROUP BY hi)
, w AS (SELECT MAX(y) FILTER (WHERE hi = 0) AS y0, MAX(n) FILTER (WHERE hi = 0) AS n0, MAX(y) FILTER (WHERE hi = 1) AS y1, MAX(n) FILTER (WHERE hi = 1) AS n1 FROM g)
, c AS (SELECT ln(y0 / (n0 - y0)) AS f0, sqrt(1 / y0 + 1 / (n0 - y0)) AS s0, ln(y1 / (n1 - y1)) - ln(y0 / (n0 - y0)) AS f1,
          sqrt(1 / y0 + 1 / (n0 - y0) + 1 / y1 + 1 / (n1 - y1)) AS s1, ln((y0 + y1) / (n0 + n1 - y0 - y1)) AS g0, sqrt(1 / (y0 + y1) + 1 / (n0 + n1 - y0 - y1)) AS t0 FROM w)
SELECT '(Intercept)' AS term, ROUND(f0, 5) AS estimate_full, ROUND(""" + D.sql_norm_p("f0 / s0") + """, 7) AS p_full, ROUND(g0, 5) AS estimate_nested,
  ROUND(""" + D.sql_norm_p("g0 / t0") + """, 7) AS p_nested FROM c
UNION ALL SELECT 'acct_high', ROUND(f1, 5), ROUND(""" + D.sql_norm_p("f1 / s1") + """, 7), NULL, NULL FROM c"""))
def compare_coefs_saturated(spark, d):
    """Full (balance class) against nested (intercept) model side by side; a term of one model only has NULLs."""
    ct = D.customers_tested(spark, d).withColumn("acct_high", (F.col("c_acctbal") > 5000).cast("double"))
    grid, terms = glm.model_grid(ct, {"cov_pos": ("cov_pos", None)}, {"nested": [], "full": ["acct_high"]})
    coefs, _ = glm.logit_grouped(grid, ["outcome", "model"], "__y_val", terms, epsilon=1e-14)
    out = glm.compare_coefs(coefs.filter("model = 'full'").drop("model"), coefs.filter("model = 'nested'").drop("model"))
    return out.select("term", *[_r(c, 5 if c[0] == "e" else 7).alias(c) for c in ("estimate_full", "p_full", "estimate_nested", "p_nested")])


# ====================================================================== C3, C13, J2: codes

_CODES_SQL = """
, vocab AS (SELECT DISTINCT regexp_extract(code, '^(.*)-[0-9]$', 1) AS local FROM (
    SELECT p_partkey || '-' || (p_partkey % 10) AS code FROM part JOIN closure ON p_partkey = descendant WHERE ancestor = 'Brand#1') v)
, results AS (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS local, l_returnflag || ' ' || l_linestatus AS type_text FROM lineitem WHERE l_linenumber > 3)"""


def _local_results(spark, d):
    """The second system: results under local codes (no check digit), and the vocabulary's codes with one."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("-", "p_partkey", F.col("p_partkey") % 10).alias("concept_code"))
    vocab = rel.semi(p, D.part_closure(spark, d).filter(F.col("ancestor") == D.TYPE_ANCESTOR).select(F.col("descendant").alias("p_partkey")), "p_partkey")
    codes = vocab.select(X.drop_check_digit("concept_code").alias("local"))
    li = table(spark, d, "lineitem").filter("l_linenumber > 3").select(
        "l_orderkey", F.col("l_partkey").cast("string").alias("local"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("type_text"))
    return rel.match_codes(li, F.col("local"), codes, "local")


@register("typed_two_systems", with_ctes(["closure"], _CODES_SQL + """
, b1 AS (SELECT DISTINCT o_custkey AS person, l_returnflag || ' ' || l_linestatus AS type_text FROM lineitem JOIN orders ON l_orderkey = o_orderkey
         JOIN closure ON l_partkey = descendant WHERE ancestor = 'Brand#1' AND l_linenumber <= 3)
, b2 AS (SELECT DISTINCT o_custkey AS person, type_text FROM results JOIN vocab USING (local) JOIN orders ON l_orderkey = o_orderkey)
SELECT DISTINCT person, CASE WHEN type_text LIKE 'A %' THEN 'A' WHEN type_text LIKE 'N %' THEN 'N' WHEN type_text LIKE 'R %' THEN 'R' END AS abo,
  CASE WHEN type_text LIKE '% O' THEN 'pos' WHEN type_text LIKE '% F' THEN 'neg' END AS rh FROM (SELECT * FROM b1 UNION SELECT * FROM b2) u"""))
def typed_two_systems(spark, d):
    """Types gathered from two systems, by the vocabulary closure and by codes without their check digit."""
    li = table(spark, d, "lineitem").filter("l_linenumber <= 3").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("person"))
    first = rel.descendants(li, "l_partkey", D.part_closure(spark, d), [D.TYPE_ANCESTOR], anc_col="ancestor", desc_col="descendant") \
        .select("l_orderkey", F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("type_text"))
    both = first.unionByName(_local_results(spark, d).filter("matched").select("l_orderkey", "type_text"))
    texts = both.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("person", "type_text").distinct()
    return D.parse_type(texts)


@register("code_match_report", with_ctes(["closure"], _CODES_SQL + """
SELECT v.local IS NOT NULL AS matched, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE r.local IS NULL) AS n_without_code, COUNT(DISTINCT r.local) AS n_codes
FROM results r LEFT JOIN vocab v USING (local) GROUP BY 1"""))
def code_match_report(spark, d):
    """J2 quality report: rows and codes of the second system that the vocabulary knows, and those it does not."""
    return rel.match_report(_local_results(spark, d))


@register("mapped_codes_parts", """
WITH closure AS (SELECT p_type AS ancestor_concept_id, p_partkey AS descendant_concept_id FROM part),
rel AS (SELECT p_partkey AS concept_id_1, p_partkey + 1000000 AS concept_id_2, CASE p_size % 3 WHEN 0 THEN 'Mapped from' WHEN 1 THEN 'Included in map from' ELSE 'Is a' END AS relationship_id FROM part),
concept AS (SELECT p_partkey + 1000000 AS concept_id, CASE WHEN p_size % 2 = 0 THEN 'ICD10CM' ELSE 'SNOMED' END AS vocabulary_id, 'C' || p_size AS concept_code FROM part)
SELECT DISTINCT ancestor_concept_id, concept_code FROM closure JOIN rel ON descendant_concept_id = concept_id_1 JOIN concept ON concept_id_2 = concept_id
WHERE relationship_id IN ('Mapped from', 'Included in map from') AND vocabulary_id = 'ICD10CM' AND ancestor_concept_id IN ('PROMO', 'ECONOMY')""")
def mapped_codes_parts(spark, d):
    """Closure -> relationship -> concept, folded into the (ancestor, code) list of one vocabulary."""
    p = table(spark, d, "part")
    closure = p.select(F.col("p_type").alias("ancestor_concept_id"), F.col("p_partkey").alias("descendant_concept_id"))
    kinds = F.element_at(F.array(F.lit("Mapped from"), F.lit("Included in map from"), F.lit("Is a")), (F.col("p_size") % 3 + 1).cast("int"))
    relationship = p.select(F.col("p_partkey").alias("concept_id_1"), (F.col("p_partkey") + 1_000_000).alias("concept_id_2"), kinds.alias("relationship_id"))
    concept = p.select((F.col("p_partkey") + 1_000_000).alias("concept_id"), F.when(F.col("p_size") % 2 == 0, "ICD10CM").otherwise("SNOMED").alias("vocabulary_id"),
                       F.concat(F.lit("C"), F.col("p_size").cast("string")).alias("concept_code"))
    return rel.mapped_codes(closure, relationship, concept, ["PROMO", "ECONOMY"])


# ====================================================================== T8: adaptive formats

@register("adaptive_formats", """
WITH s AS (SELECT l_returnflag || l_linestatus AS code, COUNT(*) AS n, COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM lineitem) AS share,
             ROUND(AVG(l_extendedprice), 4) AS price, ROUND(AVG(l_quantity), 6) + 0.25 AS quantity FROM lineitem GROUP BY 1),
f AS (SELECT * FROM s ORDER BY code LIMIT 1)
SELECT s.code, """ + ", ".join(
    f"CASE WHEN f.{c} % 1 = 0 THEN CAST(CAST(s.{c} AS BIGINT) AS VARCHAR) WHEN abs(f.{c}) < 1 THEN printf('%.1f', 100.0::DOUBLE * s.{c}) "
    f"WHEN abs(f.{c}) > 100 THEN printf('%.1f', s.{c}::DOUBLE) ELSE printf('%.0f', s.{c}::DOUBLE) END AS {c}_text" for c in ("n", "share", "price", "quantity")) + " FROM s, f")
def adaptive_formats(spark, d):
    """Four columns of four kinds, each decided by its value in the first group."""
    li = table(spark, d, "lineitem")
    total = li.agg(F.count(F.lit(1)).cast("double").alias("all"))
    s = li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("code")).agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("l_extendedprice"), 4).alias("price"), (_r(F.avg("l_quantity")) + 0.25).alias("quantity"))
    s = rel.bind_one_row(s, total).withColumn("share", F.col("n") / F.col("all"))
    return fmt.adaptive_by_first(s, ["n", "share", "price", "quantity"], ["code"]).select("code", *[f"{c}_text" for c in ("n", "share", "price", "quantity")])


# ====================================================================== X7, X9: frames

REGION_ORDER = ["EUROPE", "ASIA", "AMERICA", "AFRICA"]      # the fifth region is not listed and follows


def _meta_parts(spark, d):
    tests = D.test_results(spark, d)
    c = table(spark, d, "customer")
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey).join(tests, c.c_custkey == tests.person, "left")     # 25 nations
    counts = base.groupBy(F.col("r_name").alias("site"), F.col("c_mktsegment").alias("grp")).agg(
        F.count_if(F.col("cov_pos") == 1).cast("double").alias("cases"), F.count_if(F.col("cov_pos").isNull()).cast("double").alias("controls"))
    return meta.meta_binary(meta.meta_counts(counts, "site", "grp", "cases", "controls"))


_META = C.REGISTRY["meta_regions"][1]


@register("meta_frame_regions", _META[:_META.rindex("SELECT het.target")] + f"""
, st3 AS (SELECT ef.*, 1 / (v + tau2) AS w, SUM(1 / (v + tau2)) OVER (PARTITION BY target) AS sw FROM ef JOIN het USING (target))
, blank AS (SELECT CAST(NULL AS DOUBLE) AS q, CAST(NULL AS INTEGER) AS df, CAST(NULL AS DOUBLE) AS p_q, CAST(NULL AS DOUBLE) AS tau2, CAST(NULL AS DOUBLE) AS i2)
SELECT target, CAST(CASE site WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 WHEN 'AMERICA' THEN 2 WHEN 'AFRICA' THEN 3 ELSE 4 END AS INTEGER) AS row_order,
  'study' AS kind, site AS study, ROUND(exp(y), 6) AS odds_ratio, ROUND(exp(y - {meta.Z975} * sqrt(v)), 6) AS conf_low,
  ROUND(exp(y + {meta.Z975} * sqrt(v)), 6) AS conf_high, ROUND(100.0::DOUBLE * w / sw, 6) AS weight_random, blank.* FROM st3, blank
UNION ALL SELECT target, 5, 'pooled', 'pooled (random)', ROUND(exp(swry / swr), 6), ROUND(exp(swry / swr - {meta.Z975} * sqrt(1 / swr)), 6),
  ROUND(exp(swry / swr + {meta.Z975} * sqrt(1 / swr)), 6), 100.0::DOUBLE, blank.* FROM rnd, blank
UNION ALL SELECT target, 6, 'heterogeneity', 'heterogeneity', NULL, NULL, NULL, NULL, ROUND(q, 6), CAST(k - 1 AS INTEGER),
  ROUND({D.sql_chi2_sf("q", "CAST(k - 1 AS INTEGER)")}, 6), ROUND(tau2, 6), ROUND(GREATEST(0, (q - (k - 1)) / q), 6) FROM het""")
def meta_frame_regions(spark, d):
    """Per-study, pooled and heterogeneity rows of each target under a declared order (weights, CI, Q, p, I2)."""
    out = report.meta_frame(*_meta_parts(spark, d), order=REGION_ORDER)
    rounded = ("odds_ratio", "conf_low", "conf_high", "weight_random", "q", "p_q", "tau2", "i2")
    return out.select("target", "row_order", "kind", "study", *[_r(c).alias(c) for c in rounded[:5]], "df", *[_r(c).alias(c) for c in rounded[5:]])


@register("effect_frame_segments", with_ctes(["ctested"], C._closed_form_logit_sql(C.LOGIT_PREFIX, C.LOGIT_OUTCOMES) + """
SELECT outcome, term, CAST(CASE term WHEN 'seg_FURNITURE' THEN 0 WHEN 'seg_BUILDING' THEN 1 WHEN 'seg_HOUSEHOLD' THEN 2 ELSE 3 END AS INTEGER) AS "order",
  ROUND(exp(est), 5) AS "or", ROUND(exp(est - 1.96 * se), 5) AS lo, ROUND(exp(est + 1.96 * se), 5) AS hi FROM coef WHERE model = 'segment' AND term <> '(Intercept)'"""))
def effect_frame_segments(spark, d):
    """Plot-ready odds ratios with intervals in a declared level order (unlisted levels last)."""
    coefs, _ = C._logit_grid(spark, d)
    f = report.effect_plot_frame(coefs.filter((F.col("model") == "segment") & (F.col("term") != glm.INTERCEPT)), ["seg_FURNITURE", "seg_BUILDING", "seg_HOUSEHOLD"])
    return f.select("outcome", "term", F.col("order").cast("int").alias("order"), *[_r(c, 5).alias(c) for c in ("or", "lo", "hi")])


@register("nested_orders", """
SELECT l_orderkey, CAST(COUNT(*) AS BIGINT) AS n_lines, ROUND(SUM(l_quantity), 6) AS quantity, MIN(l_partkey) AS first_part FROM lineitem GROUP BY l_orderkey""")
def nested_orders(spark, d):
    """R9/R10 on a growing table: the lines of each order nested, used per group, and unnested again."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    nested = R.nest(li, ["l_orderkey"], "lines")
    rows = R.unnest(nested.withColumn("n_lines", F.size("lines").cast("long")), "lines")
    return rows.groupBy("l_orderkey").agg(F.max("n_lines").alias("n_lines"), _r(F.sum("l_quantity")).alias("quantity"), F.min("l_partkey").alias("first_part"))


# ====================================================================== smaller operators on whole tables

@register("coef_stack", with_ctes(["ctested"], C._closed_form_logit_sql(C.LOGIT_PREFIX, C.LOGIT_OUTCOMES[:1]) + """
SELECT 'segment model' AS comparison, term, ROUND(est, 5) AS estimate, ROUND(exp(est), 5) AS odds_ratio FROM coef WHERE model = 'segment'
UNION ALL SELECT 'null model', term, ROUND(est, 5), NULL FROM coef WHERE model = 'null'"""))
def coef_stack(spark, d):
    """The coefficients of two fits stacked under a label (one has odds ratios, the other not)."""
    coefs, _ = C._logit_grid(spark, d)
    coefs = coefs.filter("outcome = 'cov_pos'")
    out = glm.coef_table({"segment model": glm.odds_ratio(coefs.filter("model = 'segment'")), "null model": coefs.filter("model = 'null'")})
    return out.select("comparison", "term", _r("estimate", 5).alias("estimate"), _r("odds_ratio", 5).alias("odds_ratio"))


@register("events_since_first", """
SELECT event_id, ROUND((epoch_us(ts) - epoch_us(MIN(ts) OVER (PARTITION BY user_id))) / 3600000000.0, 6) AS hours FROM events""")
def events_since_first(spark, d):
    """Hours since the person's first event, on every event."""
    e = A.since_first(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", out="hours")
    return e.select("event_id", _r("hours").alias("hours"))


@register("arms_one_vs_rest", with_ctes(["ctested"], """
, c AS (SELECT c_mktsegment AS seg, SUM(cov_pos)::BIGINT AS pos, COUNT(*) AS tested FROM ctested GROUP BY c_mktsegment)
SELECT seg AS target, pos, tested, tested - pos AS neg, (SUM(pos) OVER () - pos)::BIGINT AS pos_rest, (SUM(tested) OVER () - tested)::BIGINT AS tested_rest FROM c"""))
def arms_one_vs_rest(spark, d):
    """Per level the counts of the level and of all others, and the complement arm."""
    c = D.customers_tested(spark, d).groupBy(F.col("c_mktsegment").alias("seg")).agg(F.sum("cov_pos").cast("long").alias("pos"), F.count(F.lit(1)).alias("tested"))
    out = A.with_complements(A.one_vs_rest(c, "seg", ["pos", "tested"]), {"neg": ("tested", "pos")})
    return out.select("target", "pos", "tested", "neg", *[F.col(f"rest_{x}").cast("long").alias(f"{x}_rest") for x in ("pos", "tested")])


@register("large_cells", with_ctes(["tested", "general"], C.CONT_SQL + """
SELECT family, "group", arm, n FROM cont WHERE (family, "group") IN (SELECT (family, "group") FROM cont WHERE arm = 'total_tested' AND n > 12)"""))
def large_cells(spark, d):
    """Only groups with more than 12 tested persons."""
    return K.min_cell(C.typed_contingency(spark, d), "total_tested", 12).select("family", "group", "arm", "n")


@register("column_tools", """
SELECT c_custkey AS id, CASE WHEN c_nationkey IS NULL THEN NULL WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS high, round_even(c_acctbal, 1) AS acctbal,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'auto' WHEN 'MACHINERY' THEN 'mach' ELSE c_mktsegment END AS segment FROM customer""")
def column_tools(spark, d):
    """Columns chosen by name, changed together, recoded by a map and renamed by position."""
    c = table(spark, d, "customer")
    c = c.select(*X.cols_like(c, prefix="c_")).withColumn("high", X.bool01(F.when(F.col("c_nationkey").isNotNull(), F.col("c_acctbal") > 5000)))
    c = X.across(c, ["c_acctbal"], lambda v: X.round_half_even(v, 1))
    c = c.withColumn("c_mktsegment", X.map_recode("c_mktsegment", {"AUTOMOBILE": "auto", "MACHINERY": "mach"}, default="keep"))
    return R.rename_all(c.select("c_custkey", "high", "c_acctbal", "c_mktsegment"), ["id", "high", "acctbal", "segment"])


@register("types_with_several_values", with_ctes(["typed"], """
SELECT person, COUNT(DISTINCT (abo, rh)) FILTER (WHERE abo IS NOT NULL AND rh IS NOT NULL) AS n_types, COUNT(DISTINCT (abo, rh)) AS n_with_missing
FROM typed GROUP BY person"""))
def types_with_several_values(spark, d):
    """Distinct tuples per person, without and with tuples that miss a value."""
    return D.typed(spark, d).groupBy("person").agg(A.count_distinct_tuples("abo", "rh").alias("n_types"),
                                                   A.count_distinct_tuples("abo", "rh", skip_nulls=False).alias("n_with_missing"))


@register("config_grid", """
SELECT v.window, COUNT(*) AS n FROM events, (VALUES ('short', 50.0), ('long', 10.0)) v("window", floor) WHERE value >= v.floor GROUP BY v.window""")
def config_grid(spark, d):
    """C14: every event with every row of a configuration, filtered by it (an exploded literal list, no join)."""
    g = rel.with_config(table(spark, d, "events").select("value"), [{"window": "short", "floor": 50.0}, {"window": "long", "floor": 10.0}])
    return g.filter(F.col("value") >= F.col("floor")).groupBy("window").agg(F.count(F.lit(1)).alias("n"))
