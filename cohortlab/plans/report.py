"""Publication-style report frames. Tables are DataFrames; HTML rendering is not built.

All heavy work is a grouped aggregate over persons; formatting happens on the aggregated frame.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fmt
from ..operators import agg as A
from ..operators import reshape as R
from ..operators.relational import join_null_safe
from ..session import saved


def baseline_by_group(df: DataFrame, families: Mapping[str, Sequence[str]], flags: Sequence[str],
                      total: str = "TOTAL", style: str = "fixed", percent_sign: bool = False) -> DataFrame:
    """One row per (family, group, characteristic): ``'n (pct)'`` of persons with the 0/1 flag
    (later notebook: ``sprintf('%.1f')``, no sign; the first one: ``style='round', percent_sign=True``)."""
    aggs = [F.count(F.lit(1)).alias("n_persons")] + [F.sum(F.col(f).cast("long")).alias(f) for f in flags]
    g = A.grouped_levels(df, families, aggs, total=total)
    long = g.unpivot(["family", "group", "n_persons"], list(flags), "characteristic", "n")
    return long.withColumn("pct", 100.0 * F.col("n") / F.col("n_persons")) \
        .withColumn("cell", fmt.n_pct("n", "pct", style=style, percent_sign=percent_sign))


def baseline_full(df: DataFrame, families: Mapping[str, Sequence[str]], numeric: Sequence[str], flags: Sequence[str],
                  conditional: Mapping[str, tuple[str, str]] | None = None, total: str = "TOTAL") -> DataFrame:
    """Baseline by group in long form: family, group, characteristic, n, of, mean, median, q1, q3, cell.

    ``N`` (share of its family), 0/1 ``flags`` (of N), ``conditional`` counts ``name -> (flag, given)``: rows with both,
    of those with ``given``; numeric columns as ``median (q1-q3)``. Families are levels, joint levels and TOTAL of the
    same rows: counts are one GROUPING SETS aggregate, quantiles one counted pass."""
    conditional = dict(conditional or {})
    one = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    aggs = [F.count(F.lit(1)).alias("N"), *[F.sum(one(f)).alias(f"f_{f}") for f in flags], *[F.avg(c).alias(f"m_{c}") for c in numeric]]
    for name, (flag, given) in conditional.items():
        aggs += [F.sum(one(flag) * one(given)).alias(f"c_{name}"), F.sum(one(given)).alias(f"g_{name}")]
    g = A.grouped_levels(df, families, aggs, total=total)
    whole = g.groupBy("family").agg(F.sum("N").alias("__all"))       # a few rows per family
    g = g.join(whole, "family")
    none = F.lit(None).cast("double")

    def row(name, n, of, mean=none):
        return F.struct(F.lit(name).alias("characteristic"), n.cast("long").alias("n"), of.cast("long").alias("of"), mean.alias("mean"))
    rows = [row("N", F.col("N"), F.col("__all")), *[row(f, F.col(f"f_{f}"), F.col("N")) for f in flags],
            *[row(c, F.col(f"c_{c}"), F.col(f"g_{c}")) for c in conditional], *[row(c, F.col("N"), F.col("N"), F.col(f"m_{c}")) for c in numeric]]
    long = g.select("family", "group", F.explode(F.array(*rows)).alias("r")).select("family", "group", "r.*")
    q = A.grouped_quantiles(df, families, numeric, {"q1": 0.25, "median": 0.5, "q3": 0.75}, total)
    wide = q.groupBy("family", "group", F.col("name").alias("characteristic")).agg(
        *[F.max(F.when(F.col("statistic") == s, F.col("value"))).alias(s) for s in ("median", "q1", "q3")])
    out = join_null_safe(long, wide, ["family", "group", "characteristic"], "left")
    pct = F.try_divide(100.0 * F.col("n"), F.col("of"))
    cell = F.when(F.col("characteristic").isin(list(numeric)), F.concat(fmt.fmt_fixed("median", 0), F.lit(" ("), fmt.fmt_fixed("q1", 0), F.lit("-"), fmt.fmt_fixed("q3", 0), F.lit(")"))) \
        .otherwise(F.concat(F.col("n").cast("string"), F.lit(" ("), F.coalesce(fmt.fmt_fixed(pct, 1), F.lit("NaN")), F.lit(")")))
    return out.withColumn("cell", cell)


def baseline_overall(df: DataFrame, numeric: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Overall summary: mean/median/quartiles of numeric columns, n (pct%) of flags, long form."""
    aggs = [F.avg(c).alias(f"{c}__mean") for c in numeric]
    aggs += [F.avg(F.col(f).cast("double")).alias(f"{f}__share") for f in flags]
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *aggs)
    cols = [c for c in wide.columns if c != "__n"]
    long = wide.unpivot(["__n"], cols, "key", "value")
    out = long.select(F.split("key", "__")[0].alias("characteristic"), F.split("key", "__")[1].alias("statistic"),
                      "value", F.col("__n").alias("n_persons"))
    if not numeric:
        return out
    q = A.quantiles(df, [], numeric, {"q1": 0.25, "median": 0.5, "q3": 0.75}).select(F.col("name").alias("characteristic"), "statistic", "value")
    return out.unionByName(q.crossJoin(F.broadcast(wide.select(F.col("__n").alias("n_persons")))))


def count_texts(cont: DataFrame, arms: Sequence[str], keys: Sequence[str] = ("family",), group: str = "group") -> DataFrame:
    """Per key and arm the text ``group:n (pct%), ...`` over the groups in order, percent of the arm's total."""
    keys = list(keys)
    c = cont.filter(F.col("arm").isin(list(arms)))
    tot = c.groupBy(*keys, "arm").agg(F.sum("n").alias("__t"))
    pct = fmt.strip_zeros(fmt.fmt_fixed(F.try_divide(100.0 * F.col("n"), F.col("__t")), 1))
    c = c.join(tot, [*keys, "arm"]).withColumn("text", F.concat(F.col(group), F.lit(":"), F.col("n").cast("string"), F.lit(" ("), pct, F.lit("%)")))
    return A.join_text(c, [*keys, "arm"], "text", order=group)


def test_count_table(tests: DataFrame, cont: DataFrame, comparisons: Mapping[str, Sequence[str]], keys: Sequence[str] = ("family",),
                     digits: int = 2) -> DataFrame:
    """Test results with the counts of both arms as texts, and statistic and p as texts."""
    keys, shown = list(keys), test_table(tests, digits)
    arms = sorted({a for pair in comparisons.values() for a in pair})
    texts = count_texts(cont, arms, keys)
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("comparison"), F.lit(i).alias("side"), F.lit(a).alias("arm"))
                                for n, pair in comparisons.items() for i, a in enumerate(pair)]))
    each = shown.select(*keys, "comparison").withColumn("__s", sides).filter("__s.comparison = comparison") \
        .select(*keys, "comparison", "__s.side", "__s.arm").join(texts, [*keys, "arm"], "left")
    wide = each.groupBy(*keys, "comparison").agg(*[F.max(F.when(F.col("side") == i, F.col("text"))).alias(f"group_{i + 1}_counts") for i in (0, 1)])
    return shown.join(wide, [*keys, "comparison"], "left")


def test_table(tests: DataFrame, digits: int = 2) -> DataFrame:
    """Test results with formatted statistic and p."""
    # one row per test; written first, since the formats would repeat the statistic's whole expression many times
    return saved(tests, "tests").withColumn("statistic_text", fmt.fmt_g("statistic", digits + 1)) \
        .withColumn("p_text", fmt.fmt_g("p_value", digits))


def regression_table(coefs: DataFrame, digits: int = 2, z: float = 1.96) -> DataFrame:
    """X6: 'OR (lo - hi)' and p text per term."""
    c = coefs.withColumn("or", F.exp("estimate")) \
        .withColumn("lo", F.exp(F.col("estimate") - z * F.col("std_error"))) \
        .withColumn("hi", F.exp(F.col("estimate") + z * F.col("std_error")))
    return c.withColumn("or_text", fmt.fmt_g("or", digits)) \
        .withColumn("ci_text", F.concat(fmt.fmt_g("lo", digits), F.lit(" - "), fmt.fmt_g("hi", digits))) \
        .withColumn("p_text", fmt.fmt_g("p_value", digits))


def meta_frame(studies: DataFrame, pooled: DataFrame, heterogeneity: DataFrame, order: Sequence[str],
               keys: Sequence[str] = ("target",)) -> DataFrame:
    """Per-study, pooled and heterogeneity rows under a declared row order.

    ``order`` lists the studies; unlisted ones follow, then the pooled row, then the heterogeneity row (whose
    ``odds_ratio`` columns are NULL and which carries Q, its df and p, tau2 and I2). The order is a column, nothing is
    sorted."""
    keys = list(keys)
    none = lambda c, t="double": F.lit(None).cast(t).alias(c)
    blank = [none("q"), none("df", "int"), none("p_q"), none("tau2"), none("i2")]
    last = len(order)
    s = studies.select(*keys, F.coalesce(R.level_rank("study", list(order)), F.lit(last)).cast("int").alias("row_order"), F.lit("study").alias("kind"),
                       "study", "odds_ratio", "conf_low", "conf_high", "weight_random", *blank)
    p = pooled.select(*keys, F.lit(last + 1).alias("row_order"), F.lit("pooled").alias("kind"), F.lit("pooled (random)").alias("study"),
                      "odds_ratio", "conf_low", "conf_high", F.lit(100.0).alias("weight_random"), *blank)
    h = heterogeneity.select(*keys, F.lit(last + 2).alias("row_order"), F.lit("heterogeneity").alias("kind"), F.lit("heterogeneity").alias("study"),
                             none("odds_ratio"), none("conf_low"), none("conf_high"), none("weight_random"), "q", "df", "p_q", "tau2", "i2")
    return s.unionByName(p).unionByName(h)


def risk_table(summary: DataFrame, reference_col: str = "is_reference", dash: str = "\u2014") -> DataFrame:
    """Risk and risk difference as percentages (1 decimal), NNT and risk ratio with 2 decimals, each as
    ``'est (lo to hi)'``; the reference stratum shows a dash for difference, NNT and ratio."""
    def cell(est, lo, hi, scale, decimals):
        return F.concat(fmt.fmt_fixed(F.col(est) * scale, decimals), F.lit(" ("),
                        fmt.fmt_fixed(F.col(lo) * scale, decimals), F.lit(" to "),
                        fmt.fmt_fixed(F.col(hi) * scale, decimals), F.lit(")"))
    out = summary.withColumn("risk_text", cell("risk", "risk_conf_low", "risk_conf_high", 100.0, 1))
    for m, scale, dec in (("risk_difference", 100.0, 1), ("nnt", 1.0, 2), ("relative_risk", 1.0, 2)):
        if m in summary.columns:
            out = out.withColumn(f"{m}_text", F.when(F.col(reference_col), F.lit(dash))
                                 .otherwise(cell(m, f"{m}_conf_low", f"{m}_conf_high", scale, dec)))
    return out


def effect_plot_frame(coefs: DataFrame, order: Sequence[str], term_col: str = "term", z: float = 1.96) -> DataFrame:
    """Plot-ready effect sizes with CI and an explicit level order."""
    return coefs.withColumn("or", F.exp("estimate")) \
        .withColumn("lo", F.exp(F.col("estimate") - z * F.col("std_error"))) \
        .withColumn("hi", F.exp(F.col("estimate") + z * F.col("std_error"))) \
        .withColumn("order", R.level_rank(term_col, list(order)))


def qc_report(df: DataFrame, key: str, implausible: dict | None = None) -> DataFrame:
    """Quality checks in ONE aggregate pass: row count, distinct keys, duplicated keys, NULLs per column
    and counts of implausible combinations (``{name: boolean Column or SQL predicate}``); long form."""
    implausible = implausible or {}
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct_keys")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in df.columns]
    aggs += [F.count_if(p if not isinstance(p, str) else F.expr(p)).alias(f"implausible:{n}")
             for n, p in implausible.items()]
    wide = df.agg(*aggs).withColumn("duplicate_keys", F.col("rows") - F.col("distinct_keys"))
    cols = [c for c in wide.columns]
    return wide.select(*[F.col(f"`{c}`").cast("long").alias(c) for c in cols]) \
        .unpivot([], cols, "check", "n")
