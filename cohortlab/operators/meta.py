"""Random-effects meta-analysis of odds ratios.

Inverse-variance log odds ratios with a 0.5 continuity correction for studies with a zero cell, fixed
effect -> Cochran's Q -> DerSimonian-Laird tau^2 -> random-effects pooling. Everything is two grouped
aggregate passes plus column arithmetic, so one call pools any number of meta-analyses (keys) at once.
The estimator choices are parameters because the reference relies on package defaults it does not state.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from .relational import join_small

Z975 = 1.959963984540054


def meta_counts(counts: DataFrame, site: str, group: str, cases: str, controls: str) -> DataFrame:
    """Per target group and site: events/total among cases (e) and controls (c), target vs rest.

    ``counts`` has one row per (site, group) with case and control counts.
    """
    tot = counts.groupBy(site).agg(F.sum(cases).alias("__tc"), F.sum(controls).alias("__tk"))
    j = join_small(counts, tot, site)
    return j.select(F.col(group).alias("target"), F.col(site).alias("study"),
                    F.col(cases).cast("double").alias("event_e"), F.col("__tc").cast("double").alias("n_e"),
                    F.col(controls).cast("double").alias("event_c"), F.col("__tk").cast("double").alias("n_c"))


def _study_effects(df: DataFrame, incr: float) -> DataFrame:
    a, n1, c, n2 = F.col("event_e"), F.col("n_e"), F.col("event_c"), F.col("n_c")
    b, d = n1 - a, n2 - c
    zero = (a == 0) | (b == 0) | (c == 0) | (d == 0)
    inc = F.when(zero, F.lit(incr)).otherwise(F.lit(0.0))
    a2, b2, c2, d2 = a + inc, b + inc, c + inc, d + inc
    return df.withColumn("log_or", F.log(a2 * d2 / (b2 * c2))) \
        .withColumn("var", 1.0 / a2 + 1.0 / b2 + 1.0 / c2 + 1.0 / d2) \
        .withColumn("se", F.sqrt("var")) \
        .withColumn("w_fixed", 1.0 / F.col("var"))


def meta_binary(df: DataFrame, keys: Sequence[str] = ("target",), incr: float = 0.5,
                z: float = Z975) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (studies, pooled, heterogeneity) frames.

    studies:  keys, study, log_or, se, odds_ratio, conf_low, conf_high, weight_random (%)
    pooled:   keys, odds_ratio, conf_low, conf_high, z, p_value, log_or, se, k
    heterogeneity: keys, q, df, p_q, tau2, i2, i2_low, i2_high, h, h_low, h_high
    """
    keys = list(keys)
    st = _study_effects(df, incr)
    s1 = st.groupBy(*keys).agg(
        F.sum("w_fixed").alias("sw"), F.sum(F.col("w_fixed") * F.col("log_or")).alias("swy"),
        F.sum(F.col("w_fixed") * F.col("w_fixed")).alias("sw2"),
        F.sum(F.col("w_fixed") * F.col("log_or") * F.col("log_or")).alias("swy2"),
        F.count(F.lit(1)).alias("k"))
    q = F.col("swy2") - F.col("swy") * F.col("swy") / F.col("sw")
    het = s1.withColumn("q", F.greatest(q, F.lit(0.0))).withColumn("df", (F.col("k") - 1).cast("int")) \
        .withColumn("tau2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(
            F.col("q") - F.col("df"), F.col("sw") - F.col("sw2") / F.col("sw")), F.lit(0.0))))
    st2 = st.join(het.select(*keys, "tau2"), keys).withColumn("w_random", 1.0 / (F.col("var") + F.col("tau2")))
    s2 = st2.groupBy(*keys).agg(F.sum("w_random").alias("swr"),
                                F.sum(F.col("w_random") * F.col("log_or")).alias("swry"),
                                F.count(F.lit(1)).alias("k"))
    mu = F.col("swry") / F.col("swr")
    se = F.sqrt(1.0 / F.col("swr"))
    pooled = s2.select(*keys, mu.alias("log_or"), se.alias("se"), "k") \
        .withColumn("odds_ratio", F.exp("log_or")) \
        .withColumn("conf_low", F.exp(F.col("log_or") - z * F.col("se"))) \
        .withColumn("conf_high", F.exp(F.col("log_or") + z * F.col("se"))) \
        .withColumn("z", F.col("log_or") / F.col("se")) \
        .withColumn("p_value", dist.norm_two_sided_p(F.col("z")))
    studies = st2.join(s2.select(*keys, "swr"), keys).select(
        *keys, "study", "log_or", "se", F.exp("log_or").alias("odds_ratio"),
        F.exp(F.col("log_or") - z * F.col("se")).alias("conf_low"),
        F.exp(F.col("log_or") + z * F.col("se")).alias("conf_high"),
        (100.0 * F.col("w_random") / F.col("swr")).alias("weight_random"))
    # Higgins & Thompson (2002) intervals for H and I^2
    kq, dfq = F.col("q"), F.col("df").cast("double")
    # undefined quantities (one study, Q = 0, k <= 2) are NULL rather than errors
    se_ln_h = F.when(kq > F.col("k"), F.try_divide(0.5 * (F.log(kq) - F.log(dfq)),
                                                   F.sqrt(2.0 * kq) - F.sqrt(2.0 * F.col("k") - 3.0))) \
        .when(F.col("k") > 2, F.sqrt(1.0 / (2.0 * (F.col("k") - 2.0)) * (1.0 - 1.0 / (3.0 * F.pow(F.col("k") - 2.0, 2)))))
    h = F.greatest(F.lit(1.0), F.sqrt(F.try_divide(kq, dfq)))
    heterogeneity = het.select(*keys, "q", "df", "tau2", "k") \
        .withColumn("p_q", F.when(F.col("df") > 0, dist.chi2_sf(F.col("q"), F.col("df")))) \
        .withColumn("i2", F.greatest(F.lit(0.0), F.try_divide(F.col("q") - F.col("df"), F.col("q")))) \
        .withColumn("h", F.sqrt(F.try_divide(F.col("q"), dfq))) \
        .withColumn("__se", se_ln_h) \
        .withColumn("h_low", F.greatest(F.lit(1.0), F.exp(F.log(h) - z * F.col("__se")))) \
        .withColumn("h_high", F.greatest(F.lit(1.0), F.exp(F.log(h) + z * F.col("__se")))) \
        .withColumn("i2_low", F.greatest(F.lit(0.0), (F.pow("h_low", 2) - 1.0) / F.pow("h_low", 2))) \
        .withColumn("i2_high", F.greatest(F.lit(0.0), (F.pow("h_high", 2) - 1.0) / F.pow("h_high", 2))) \
        .drop("__se")
    return studies, pooled, heterogeneity

