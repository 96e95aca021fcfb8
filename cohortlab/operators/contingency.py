"""Contingency tables and tests.

Spark does the counting over persons; tests run on the aggregated long frame
``(keys..., group, arm, n)`` whose size is (#groups x #arms) per key — independent of the data size.

* :func:`chisq` — Pearson chi-squared (Yates on 2x2, R ``chisq.test`` default), native expressions.
* :func:`fisher_pvalue` — exact two-sided p, native: support rows by ``explode(sequence(lo, hi))``.
* :func:`fisher_exact` — conditional-MLE odds ratio, 95% CI and p; pieces of the support are rows, and the brackets of
  all tables' roots are a DataFrame that is narrowed round by round.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..session import run_by_value, saved
from .agg import grouped_levels
from .vectors import lists, matrix, summed


# ---------------------------------------------------------------- K1

def contingency(df: DataFrame, families: Mapping[str, Sequence[str]], arms: Mapping[str, object],
                complements: Mapping[str, tuple[str, str]] | None = None, sep: str = "-",
                total: str | None = None) -> DataFrame:
    """K1: long contingency ``(family, group, arm, n)`` from person rows in one grouping-sets pass.

    ``arms`` maps an arm name to a 0/1 column (or Column) summed per group; ``complements`` derives
    arms by difference (e.g. covid_negative = total_tested - covid_positive).
    """
    def as_col(v):
        if isinstance(v, str):
            return F.col(v)
        return v if isinstance(v, Column) else F.lit(v)

    aggs = [F.sum(as_col(v).cast("long")).alias(k) for k, v in arms.items()]
    wide = grouped_levels(df, families, aggs, total=total, sep=sep)
    for name, (a, b) in (complements or {}).items():
        wide = wide.withColumn(name, F.col(a) - F.col(b))
    arm_cols = list(arms) + list(complements or {})
    return wide.unpivot(["family", "group"], arm_cols, "arm", "n")


def add_external(cont: DataFrame, external: DataFrame) -> DataFrame:
    """Append external / comparison-population counts ``(family, group, arm, n)``."""
    return cont.unionByName(external.select("family", "group", "arm", F.col("n").cast("long").alias("n")))


def _arm_config(spark, comparisons: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(name, arm, i) for name, arms in comparisons.items() for i, arm in enumerate(arms)]
    return spark.createDataFrame(rows, "comparison string, arm string, col_idx int")


# ---------------------------------------------------------------- K2 / K3 / K4

def chisq(cont: DataFrame, comparisons: Mapping[str, Sequence[str]], keys: Sequence[str] = (),
          group: str = "group", correct: bool = True) -> DataFrame:
    """K2: Pearson chi-squared of group x arms for each named comparison (arm list of length >= 2).

    Matches R ``chisq.test`` on the matrix: expected = row*col/total; with ``correct`` and a 2x2 table
    the Yates term ``min(0.5, min|o - e|)`` is subtracted. Output: keys, comparison, statistic,
    parameter (df), p_value, method.
    """
    keys = list(keys)
    arms = sorted({a for v in comparisons.values() for a in v})
    per_arm = cont.filter(F.col("arm").isin(arms)).groupBy(*keys, group, "arm").agg(F.sum("n").cast("double").alias("o"))
    # the comparisons are literal configuration: every arm's row goes to each comparison that names it
    named = F.array_compact(F.array(*(F.when(F.col("arm").isin(list(v)), F.lit(k)) for k, v in comparisons.items())))
    cells = per_arm.withColumn("comparison", F.explode(named)).withColumnRenamed("arm", "__arm").withColumnRenamed(group, "__group")
    n_cols = F.create_map(*[F.lit(x) for k, v in comparisons.items() for x in (k, len(v))])
    n_groups = cont.groupBy(*keys).agg(F.count_distinct(group).alias("__nr"))
    return _chisq_cells(cells, keys, ["comparison"], n_groups, n_cols[F.col("comparison")], correct)


def _matched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Join on the keys; without keys the right side is a one-row aggregate."""
    return left.join(right, on) if on else left.crossJoin(F.broadcast(right))


def _chisq_cells(cells: DataFrame, keys: list[str], named: list[str], n_groups: DataFrame, n_cols: Column, correct: bool) -> DataFrame:
    """The test from its non-zero cells ``(keys, comparison, __group, __arm, o)``.

    A zero cell adds its expected count, and expected counts add up to the total, so zero cells need no grid.
    A row or column of the table that has no cell makes the statistic undefined (NULL).
    """
    part = keys + named
    cells = cells.filter("o > 0")
    rows = cells.groupBy(*part, "__group").agg(F.sum("o").alias("__rt"))
    cols = cells.groupBy(*part, "__arm").agg(F.sum("o").alias("__ct"))
    tot = rows.groupBy(*part).agg(F.sum("__rt").alias("__tot"), F.count(F.lit(1)).alias("__rows"), F.product("__rt").alias("__rp"))
    ct = cols.groupBy(*part).agg(F.count(F.lit(1)).alias("__cols"), F.product("__ct").alias("__cp"))
    tot = _matched(_matched(tot, ct, part), n_groups, keys)
    e = _matched(cells.join(rows, [*part, "__group"]).join(cols, [*part, "__arm"]), tot, part) \
        .withColumn("e", F.col("__rt") * F.col("__ct") / F.col("__tot"))
    gap = F.col("o") - F.col("e")
    agg = e.groupBy(*part).agg(
        F.sum(gap * gap / F.col("e")).alias("__s"), F.sum("e").alias("__se"), F.max(F.abs(gap)).alias("__gap"),
        *[F.first(c).alias(c) for c in ("__tot", "__rows", "__cols", "__rp", "__cp", "__nr")]).withColumn("__nc", n_cols)
    whole = (F.col("__rows") == F.col("__nr")) & (F.col("__cols") == F.col("__nc"))
    two = (F.col("__nr") == 2) & (F.col("__nc") == 2) & F.lit(bool(correct))
    yates = F.least(F.lit(0.5), F.col("__gap"))        # all four gaps of a 2x2 table are equal
    corrected = F.pow(F.col("__gap") - yates, 2) * F.pow("__tot", 3) / (F.col("__rp") * F.col("__cp"))
    plain = F.col("__s") + F.greatest(F.lit(0.0), F.col("__tot") - F.col("__se"))
    agg = agg.select(*part, F.when(whole, F.when(two, corrected).otherwise(plain)).alias("statistic"),
                     ((F.col("__nr") - 1) * (F.col("__nc") - 1)).cast("int").alias("parameter"), (two & (yates > 0)).alias("__yates"))
    return agg.select(*part, "statistic", "parameter",
                      dist.chi2_sf(F.col("statistic"), F.col("parameter")).alias("p_value"),
                      F.when(F.col("__yates"), F.lit("Pearson's Chi-squared test with Yates' continuity correction"))
                      .otherwise(F.lit("Pearson's Chi-squared test")).alias("method"))


def chisq_crosstab(df: DataFrame, a: str, b: str, correct: bool = True, name: str | None = None) -> DataFrame:
    """K3: chi-squared of two person-level categoricals (their levels are those that occur; zero cells count)."""
    label = name or f"{a}_vs_{b}"
    cells = df.groupBy(F.col(a).alias("__group"), F.col(b).alias("__arm")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    n_groups = cells.agg(F.count_distinct("__group").alias("__nr"))
    out = _chisq_cells(cells, [], [], n_groups, F.col("__cols"), correct)
    return out.select(F.lit(label).alias("comparison"), "*")


def chisq_sites(site_counts: DataFrame, site_a: str, site_b: str, group: str = "group", site: str = "site",
                n: str = "n") -> DataFrame:
    """Homogeneity of the group distribution between two sites.

    Besides the tail p-value, reports what the reference prints for tiny p: the chi-squared log DENSITY at
    the statistic split into a mantissa ``a`` and base-10 exponent ``b`` (both rounded to 1 decimal) and
    the text ``'{a}e{b}'``.
    """
    from ..functions.fmt import _strip_zeros
    cont = site_counts.select(F.col(group).alias("group"), F.col(site).alias("arm"), F.col(n).alias("n"))
    res = chisq(cont, {f"{site_a}_vs_{site_b}": [site_a, site_b]})
    me = dist.mantissa_exponent(dist.chi2_logpdf(F.col("statistic"), F.col("parameter")))
    res = res.withColumn("log_density", dist.chi2_logpdf(F.col("statistic"), F.col("parameter"))) \
        .withColumn("density_mantissa", F.bround(me["mantissa"], 1)) \
        .withColumn("density_exponent", me["exponent"])
    text = F.concat(_strip_zeros(F.format_string("%.1f", F.col("density_mantissa"))), F.lit("e"),
                    F.col("density_exponent").cast("string"))
    return res.withColumn("formatted", text)


# ---------------------------------------------------------------- K5

def one_vs_rest_2x2(cont: DataFrame, comparisons: Mapping[str, Sequence[str]], keys: Sequence[str] = (),
                    group: str = "group") -> DataFrame:
    """D18 for tests: per group and comparison the 2x2 ``[[a, b], [c, d]]`` = [group, rest] x [arm1, arm2]."""
    keys = list(keys)
    if any(len(v) != 2 for v in comparisons.values()):
        raise ValueError("a 2x2 table compares exactly two arms")
    cfg = F.broadcast(_arm_config(cont.sparkSession, comparisons))      # literal configuration
    j = cont.join(cfg, "arm")
    own = j.groupBy(*keys, "comparison", group).agg(
        F.coalesce(F.sum(F.when(F.col("col_idx") == 0, F.col("n"))), F.lit(0)).cast("long").alias("a"),
        F.coalesce(F.sum(F.when(F.col("col_idx") == 1, F.col("n"))), F.lit(0)).cast("long").alias("b"))
    tot = own.groupBy(*keys, "comparison").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return own.join(tot, keys + ["comparison"]).select(
        *keys, "comparison", F.col(group).alias("blood_group"), "a", "b",
        (F.col("ta") - F.col("a")).alias("c"), (F.col("tb") - F.col("b")).alias("d"))


#: support values generated per task when a Fisher support is exploded
FISHER_CHUNK = 1 << 20


def fisher_pvalue(tables: DataFrame, rel_err: float = 1 + 1e-7, chunk: int = FISHER_CHUNK) -> DataFrame:
    """Exact two-sided Fisher p for rows with a, b, c, d (native: support exploded, lgamma closed form).

    p = sum of P(X = x) over the support with P(X = x) <= P(X = a) * (1 + 1e-7) (R's relErr). The
    density is scaled by its value at the hypergeometric mode (closed form), so no window is needed and
    the sum is a plain grouped aggregate; the support is generated in chunks that are spread over tasks
    (a support can have as many values as the smaller margin).
    """
    cols = tables.columns
    m = F.col("a") + F.col("c")
    n = F.col("b") + F.col("d")
    k = F.col("a") + F.col("b")
    lo = F.greatest(F.lit(0), k - n).cast("long")
    hi = F.least(k, m).cast("long")
    mode = F.least(F.greatest(F.floor((k + 1) * (m + 1) / (m + n + 2)).cast("long"), lo), hi)

    def ld(x):
        return dist.lchoose(m, x) + dist.lchoose(n, k - x)

    t = tables.select(*cols, lo.alias("__lo"), hi.alias("__hi"), ld(mode).alias("__mx"), ld(F.col("a")).alias("__lobs"))
    nchunks = F.floor((F.col("__hi") - F.col("__lo")) / chunk).cast("long")
    parts = t.select("*", F.explode(F.sequence(F.lit(0).cast("long"), nchunks)).alias("__c"))
    parts = parts.repartition(max(1, tables.sparkSession.sparkContext.defaultParallelism), *cols, "__c")
    start = F.col("__lo") + F.col("__c") * chunk
    end = F.least(F.col("__hi"), start + (chunk - 1))
    sup = parts.select("*", F.explode(F.sequence(start, end)).alias("__x"))
    d = F.exp(ld(F.col("__x")) - F.col("__mx"))
    keep = d <= F.exp(F.col("__lobs") - F.col("__mx")) * rel_err
    agg = sup.groupBy(*cols).agg(F.sum(F.when(keep, d).otherwise(0.0)).alias("__num"), F.sum(d).alias("__den"))
    return agg.select(*cols, F.least(F.lit(1.0), F.col("__num") / F.col("__den")).alias("p_value"))


#: support values in one row of the Fisher windows
FISHER_STEP = 1 << 16
#: points tried in each bracket per round; 11 rounds divide it by 33**11 > 2**55
FISHER_POINTS, FISHER_ROUNDS = 32, 11
_WINDOW = "__id long, __lo long, __hi long, __first boolean, __m long, __n long, __k long, __c long, __q long"


def _log_ratios(x: np.ndarray, m: int, n: int, k: int) -> np.ndarray:
    """log f(x) / f(x - 1) of the hypergeometric density of x out of m, k drawn, n others."""
    return np.log(m - x + 1.0) + np.log(k - x + 1.0) - np.log(x) - np.log(n - k + x)


def _window_rows(batches):
    """Rows of a window as plain integers."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1), {c: batch.column(c)[i].as_py() for c in batch.schema.names if c.startswith("__") and c not in ("__t",)}


def _log_density(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """The support values of a window row and their log density relative to the centre."""
    x = np.arange(r["__lo"], r["__hi"] + 1, dtype=np.float64)
    steps = np.concatenate([[0.0], _log_ratios(x[1:], r["__m"], r["__n"], r["__k"])])
    if not r["__first"]:
        steps[0] = _log_ratios(x[:1], r["__m"], r["__n"], r["__k"])[0]
    return x, r["__base"] + np.cumsum(steps)


def _windows(tables: DataFrame, centre: Column, width: Column, name: str) -> DataFrame:
    """Support values within ``width`` of ``centre`` as rows of FISHER_STEP values with the log density (relative to the
    centre) before them. Log ratios of neighbours are summed per row and rows are scanned per table, so no closed form
    loses digits on large tables and no task holds a table's support."""
    lo, hi = F.greatest(F.col("__slo"), centre - width), F.least(F.col("__shi"), centre + width)
    t = tables.select("__id", F.col("__mm").alias("__m"), F.col("__nn").alias("__n"), F.col("__kk").alias("__k"), centre.alias("__c"),
                      F.col("__aa").alias("__q"), lo.alias("__wlo"), hi.alias("__whi"))
    t = t.withColumn("__lo", F.explode(F.sequence("__wlo", "__whi", F.lit(FISHER_STEP).cast("long"))))
    rows = t.select("__id", "__lo", F.least(F.col("__lo") + (FISHER_STEP - 1), F.col("__whi")).alias("__hi"), (F.col("__lo") == F.col("__wlo")).alias("__first"),
                    "__m", "__n", "__k", "__c", "__q")
    n_parts = int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n_parts, "__id", "__lo")

    def totals(batches):
        for row, r in _window_rows(batches):
            _, cum = _log_density({**r, "__base": 0.0})
            at = float(cum[r["__c"] - r["__lo"]]) if r["__lo"] <= r["__c"] <= r["__hi"] else None
            yield pa.RecordBatch.from_arrays([*row.columns, pa.array([float(cum[-1])]), pa.array([at], pa.float64())], names=[*row.schema.names, "__sum", "__at"])

    run_by_value(__name__)
    sums = saved(rows.mapInArrow(totals, _WINDOW + ", __sum double, __at double"), name)
    # a table has a few rows here (the square root of its counts over FISHER_STEP)
    before = Window.partitionBy("__id").orderBy("__lo").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("__sum").over(before), F.lit(0.0))
    at = sums.withColumn("__b", base)
    centre_at = at.filter("__at is not null").select("__id", (F.col("__b") + F.col("__at")).alias("__z"))
    out = at.join(centre_at, "__id").withColumn("__base", F.col("__b") - F.col("__z")).drop("__sum", "__at", "__b", "__z")
    return saved(out, name)


def _fisher_roots(windows: DataFrame, start: DataFrame, alpha: float) -> DataFrame:
    """Brackets (estimate, lower, upper log odds ratio) narrowed round by round: (__id, __t[6])."""
    def sums(batches):
        for row, r in _window_rows(batches):
            x, log_f = _log_density(r)
            d, t = x - r["__q"], np.asarray(row.column("__t")[0].as_py()).reshape(3, 2)
            out = []
            for j in range(3):
                points = t[j, 0] + (t[j, 1] - t[j, 0]) * np.arange(1, FISHER_POINTS + 1) / (FISHER_POINTS + 1)
                for p in points:
                    f = np.exp(np.minimum(log_f + p * d, 600.0))    # far from the root only the sign matters
                    out += [f.sum(), (d * f).sum() if j == 0 else f[d >= 0].sum() if j == 1 else f[d <= 0].sum()]
            yield pa.RecordBatch.from_arrays([row.column("__id"), lists(np.array([out]))], names=["__id", "v"])

    def narrowed(batches):
        for batch in batches:
            if batch.num_rows:
                t, v = matrix(batch.column("__t")).reshape(-1, 3, 2), matrix(batch.column("v")).reshape(-1, 3, FISHER_POINTS, 2)
                g = v[..., 1] / v[..., 0]
                g[:, 1] -= alpha
                g[:, 2] = alpha - g[:, 2]                           # all three increase in the log odds ratio
                below = (g < 0).sum(axis=2)
                grid = t[..., :1] + (t[..., 1:] - t[..., :1]) * np.arange(FISHER_POINTS + 2) / (FISHER_POINTS + 1)
                new = np.stack([np.take_along_axis(grid, below[..., None], 2)[..., 0], np.take_along_axis(grid, below[..., None] + 1, 2)[..., 0]], axis=2)
                yield pa.RecordBatch.from_arrays([batch.column("__id"), lists(new.reshape(len(new), 6))], names=["__id", "__t"])

    run_by_value(__name__, "cohortlab.operators.vectors")
    state = start
    for _ in range(FISHER_ROUNDS):
        found = summed(windows.join(state, "__id").mapInArrow(sums, "__id long, v array<double>"), ["__id"])
        state = saved(found.join(state, "__id").mapInArrow(narrowed, "__id long, __t array<double>"), "fisher-brackets")
    return state


def _fisher_p(windows: DataFrame, rel_err: float = 1 + 1e-7) -> DataFrame:
    """Two-sided p from windows around the mode: (__id, __p); an observed count outside has p 0 in double precision."""
    def own(batches):
        for row, r in _window_rows(batches):
            if r["__lo"] <= r["__q"] <= r["__hi"]:
                yield pa.RecordBatch.from_arrays([row.column("__id"), pa.array([float(_log_density(r)[1][r["__q"] - r["__lo"]])])], names=["__id", "__own"])

    def parts(batches):
        for row, r in _window_rows(batches):
            f = np.exp(_log_density(r)[1])
            v = [f.sum(), f[f <= np.exp(r["__own"]) * rel_err].sum() if r["__own"] is not None else 0.0]
            yield pa.RecordBatch.from_arrays([row.column("__id"), lists(np.array([v]))], names=["__id", "v"])

    run_by_value(__name__, "cohortlab.operators.vectors")
    at = windows.join(windows.mapInArrow(own, "__id long, __own double"), "__id", "left")
    v = summed(at.mapInArrow(parts, "__id long, v array<double>"), ["__id"])
    return v.select("__id", F.least(F.lit(1.0), F.element_at("v", 2) / F.element_at("v", 1)).alias("__p"))


def fisher_exact(tables: DataFrame, conf_level: float = 0.95) -> DataFrame:
    """K5: Fisher exact test per row of ``(…, a, b, c, d)``: estimate, conf_low, conf_high, p_value.

    The conditional maximum-likelihood odds ratio and its interval are roots in the log odds ratio of the noncentral
    hypergeometric; all tables' brackets are narrowed together, a fixed number of rounds, with the support around the
    observed count (60 standard deviations: beyond it terms are 0 in double precision) as rows spread over tasks."""
    cols = tables.columns
    m, n, k = F.col("a") + F.col("c"), F.col("b") + F.col("d"), F.col("a") + F.col("b")
    t = tables.withColumn("__id", F.monotonically_increasing_id()).withColumns({
        "__mm": m.cast("long"), "__nn": n.cast("long"), "__kk": k.cast("long"), "__aa": F.col("a").cast("long"),
        "__slo": F.greatest(F.lit(0), k - n).cast("long"), "__shi": F.least(k, m).cast("long")})
    t = saved(t, "fisher-tables")
    inverse = sum((1.0 / (F.col(c) + 0.5) for c in "abcd"), F.lit(0.0))
    near = F.ceil(60.0 / F.sqrt(inverse) + 200.0).cast("long")
    mode = F.least(F.greatest(F.floor((F.col("__kk") + 1) * ((F.col("__mm") + 1) / (F.col("__mm") + F.col("__nn") + 2))).cast("long"), F.col("__slo")), F.col("__shi"))
    total = (F.col("__mm") + F.col("__nn")).cast("double")
    spread = F.sqrt(F.col("__kk") * (F.col("__mm") / total) * (F.col("__nn") / total) * (total - F.col("__kk")) / F.greatest(total - 1, F.lit(1.0)))
    some = t.filter("__mm + __nn > 0")
    log_or = F.log((F.col("a") + 0.5) * (F.col("d") + 0.5) / ((F.col("b") + 0.5) * (F.col("c") + 0.5)))
    reach = 20.0 * F.sqrt(inverse) + 5.0
    start = saved(some.select("__id", F.flatten(F.array_repeat(F.array(log_or - reach, log_or + reach), 3)).alias("__t")), "fisher-brackets")
    roots = _fisher_roots(_windows(some, F.col("__aa"), near, "fisher-window"), start, (1 - conf_level) / 2)
    p = _fisher_p(_windows(some, mode, F.ceil(60.0 * spread + 200.0).cast("long"), "fisher-null"))
    root = lambda j: F.exp((F.element_at("__t", 2 * j + 1) + F.element_at("__t", 2 * j + 2)) / 2)
    low_end, high_end, inf = F.col("__aa") == F.col("__slo"), F.col("__aa") == F.col("__shi"), F.lit(float("inf"))
    out = t.join(roots, "__id", "left").join(p, "__id", "left")
    return out.select(*cols, F.when(low_end, 0.0).when(high_end, inf).otherwise(root(0)).alias("estimate"), F.when(low_end, 0.0).otherwise(root(1)).alias("conf_low"),
                      F.when(high_end, inf).otherwise(root(2)).alias("conf_high"), F.coalesce("__p", F.lit(1.0)).alias("p_value"),
                      F.lit("Fisher's Exact Test for Count Data").alias("method"), F.lit("two.sided").alias("alternative"))


def min_cell(cont: DataFrame, arm: str, k: int, keys: Sequence[str] = ("family",), group: str = "group") -> DataFrame:
    """Keep groups whose count in ``arm`` is greater than ``k`` (e.g. total_tested > 5)."""
    ok = cont.filter((F.col("arm") == arm) & (F.col("n") > k)).select(*keys, group)
    return cont.join(ok, [*keys, group], "left_semi")
