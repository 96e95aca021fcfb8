"""Aggregations and window-style operators.

Partition totals (E1/E2/E5) are computed as grouped aggregates joined back to the rows (checked
broadcast of the per-key totals) rather than as key-partitioned windows: partial aggregation makes
them skew-safe, whereas a window over a key holding a third of the rows is one task.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import epoch_micros, micros_between
from .relational import join_null_safe, join_small


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# ---------------------------------------------------------------- D2, D3, D6, D11, D12

def count_if(cond: Column) -> Column:
    """Conditional count."""
    return F.count_if(cond)


def ever(c) -> Column:
    """D3: boolean "ever" over a group."""
    return F.bool_or(c if isinstance(c, Column) else F.col(c))


def count_distinct_tuples(*cols, skip_nulls: bool = True) -> Column:
    """``COUNT(DISTINCT a, b)`` skips tuples with a NULL (Q4); R's ``n_distinct`` counts them."""
    if skip_nulls:
        return F.count_distinct(*[F.col(c) for c in cols])
    return F.count_distinct(F.struct(*[F.col(c) for c in cols]))


def grouped_levels(df: DataFrame, families: Mapping[str, Sequence[str]], aggs: Sequence[Column],
                   label: str = "family", total: str | None = "TOTAL", sep: str = "-",
                   group_col: str = "group") -> DataFrame:
    """Aggregate at several grouping levels in ONE pass (``GROUPING SETS``).

    ``families`` maps a family label to its grouping columns, e.g. ``{'abo': ['abo'], 'rh': ['rh'],
    'abo_rh': ['abo', 'rh']}``; with ``total`` an empty grouping set is added. Output columns:
    ``family, group, <aggs>`` where ``group`` joins the family's values with ``sep``.
    """
    all_cols = []
    for cs in families.values():
        for c in cs:
            if c not in all_cols:
                all_cols.append(c)
    sets = [[F.col(c) for c in cs] for cs in families.values()]
    if total is not None:
        sets.append([])
    g = df.groupingSets(sets, *[F.col(c) for c in all_cols]).agg(
        *aggs, *[F.grouping(c).alias(f"__g_{c}") for c in all_cols])
    fam_expr = None
    grp_expr = None
    for name, cs in families.items():
        cond = F.lit(True)
        for c in all_cols:
            cond = cond & (F.col(f"__g_{c}") == (0 if c in cs else 1))
        lab = F.concat(*[F.lit(sep) if i % 2 else F.col(cs[i // 2]).cast("string") for i in range(2 * len(cs) - 1)])
        fam_expr = F.when(cond, F.lit(name)) if fam_expr is None else fam_expr.when(cond, F.lit(name))
        grp_expr = F.when(cond, lab) if grp_expr is None else grp_expr.when(cond, lab)
    if total is not None:
        fam_expr = fam_expr.otherwise(F.lit(total))
        grp_expr = grp_expr.otherwise(F.lit(total))
    agg_names = [c for c in g.columns if c not in all_cols and not c.startswith("__g_")]
    return g.select(fam_expr.alias(label), grp_expr.alias(group_col), *agg_names)


def null_counts(df: DataFrame) -> DataFrame:
    """NULL count of every column in one pass, long form (column, n_null)."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "n_null")


# ---------------------------------------------------------------- D13-D21

#: texts one key may collect; more is an error, not a memory problem
MAX_TEXTS = 100_000


def join_text(df: DataFrame, keys: Sequence[str], text: str, order: str | None = None, sep: str = ", ",
              out: str | None = None, distinct: bool = False, max_texts: int = MAX_TEXTS) -> DataFrame:
    """Ordered string aggregation per key (by ``order``, then text); NULL texts are left out.

    Equal (order, text) pairs are counted before anything is collected, so a hot key shuffles each of them once per
    task and is repeated (or, ``distinct``, not) only in the text. A key with more than ``max_texts`` different pairs
    raises an error before its texts are collected.
    """
    keys, order = list(keys), order or text
    pairs = df.filter(F.col(text).isNotNull()).groupBy(*keys, F.col(order).alias("__o"), F.col(text).cast("string").alias("__t")) \
        .agg(F.count(F.lit(1)).cast("int").alias("__k"))
    sizes = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    fits = F.when(F.col("__n") <= max_texts, F.col("__t")).otherwise(F.raise_error(F.lit(f"more than {max_texts} texts to join for one key")))
    pairs = join_null_safe(pairs, sizes, keys).withColumn("__t", fits)
    times = F.lit(1) if distinct else F.col("__k")
    arr = F.array_sort(F.collect_list(F.struct(F.col("__o").alias("o"), F.col("__t").alias("t"), times.alias("k"))))
    texts = F.flatten(F.transform(arr, lambda x: F.array_repeat(x["t"], x["k"])))
    return pairs.groupBy(*keys).agg(F.array_join(texts, sep).alias(out or text))


def consensus(df: DataFrame, key: str, value: str, none: str = "missing", many: str = "other",
              out: str | None = None) -> DataFrame:
    """One distinct value -> it, none -> ``none``, several -> ``many``."""
    n = F.count_distinct(F.col(value))
    return df.groupBy(key).agg(
        F.when(n == 1, F.max(value)).when(n == 0, F.lit(none)).otherwise(F.lit(many)).alias(out or value))


def crosstab(df: DataFrame, a: str, b: str, a_levels: Sequence | None = None,
             b_levels: Sequence | None = None) -> DataFrame:
    """Counts for every (a, b) pair, including zero cells (right join to the level product)."""
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    la = (df.sparkSession.createDataFrame([(x,) for x in a_levels], [a]) if a_levels is not None
          else df.select(a).distinct())
    lb = (df.sparkSession.createDataFrame([(x,) for x in b_levels], [b]) if b_levels is not None
          else df.select(b).distinct())
    grid = la.crossJoin(lb)  # level sets are small (categorical levels)
    return grid.join(counts, [a, b], "left").fillna(0, subset=["n"])


def corr_long(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Lower triangle of the Pearson correlation matrix, long form (var1, var2, corr), one pass."""
    cols = list(cols)
    if method != "pearson":
        # Q21: the reference computes Pearson (labelled Spearman); a rank transform needs a global sort.
        raise ValueError("only method='pearson' is supported")
    src = df
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i)]
    wide = src.agg(*[F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"{x}\u0001{y}")
                     for x, y in pairs])
    long = wide.unpivot([], [f"{x}\u0001{y}" for x, y in pairs], "pair", "corr")
    return long.select(F.split("pair", "\u0001")[0].alias("var1"), F.split("pair", "\u0001")[1].alias("var2"),
                       "corr")


def histogram(df: DataFrame, c: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram over [min, max] (times become epoch seconds)."""
    x = F.col(c)
    xv = epoch_micros(x) / 1e6 if dict(df.dtypes)[c] in ("date", "timestamp", "timestamp_ntz") else x.cast("double")
    base = df.select(*by, xv.alias("__x"))
    mm = base.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    b = base.crossJoin(F.broadcast(mm)).withColumn(
        "bin", F.least(F.width_bucket("__x", "__lo", F.col("__hi") + F.lit(0.0), F.lit(bins)), F.lit(bins)))
    width = (F.col("__hi") - F.col("__lo")) / bins
    return b.groupBy(*by, "bin", "__lo", "__hi").agg(F.count(F.lit(1)).alias("n")).select(
        *by, "bin", (F.col("__lo") + (F.col("bin") - 1) * width).alias("bin_start"),
        (F.col("__lo") + F.col("bin") * width).alias("bin_end"), "n")


def one_vs_rest(counts: DataFrame, group: str, value_cols: Sequence[str], target_col: str = "target",
                by: Sequence[str] = ()) -> DataFrame:
    """For every group, its own counts vs. the sum of all other groups (rest = total - own)."""
    tot = counts.groupBy(*by).agg(*[F.sum(c).alias(f"__t_{c}") for c in value_cols])
    j = join_small(counts, tot, list(by)) if by else counts.crossJoin(F.broadcast(tot))     # one row
    own = [F.col(c).alias(c) for c in value_cols]
    rest = [(F.col(f"__t_{c}") - F.col(c)).alias(f"rest_{c}") for c in value_cols]
    return j.select(*by, F.col(group).alias(target_col), *own, *rest)


def with_complements(df: DataFrame, complements: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Derived arms, ``{'covid_negative': ('total_tested', 'covid_positive')}`` -> a - b."""
    for name, (a, b) in complements.items():
        df = df.withColumn(name, F.col(a) - F.col(b))
    return df


def flow(steps: Sequence[tuple[str, DataFrame]], key: str | None = None) -> DataFrame:
    """Cohort-flow table: one (step, n) row per named frame (distinct keys when ``key`` given)."""
    frames = []
    for i, (name, d) in enumerate(steps):
        n = F.count_distinct(key) if key else F.count(F.lit(1))
        frames.append(d.agg(n.cast("long").alias("n")).select(F.lit(i).alias("step_order"), F.lit(name).alias("step"), "n"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def zscore(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """(x - mean) / sd via a one-row aggregate broadcast back (no single-task global window)."""
    st = df.agg(F.avg(c).alias("__mu"), F.stddev_samp(c).alias("__sd"))
    return df.crossJoin(F.broadcast(st)).withColumn(out or f"{c}_z", (F.col(c) - F.col("__mu")) / F.col("__sd")) \
        .drop("__mu", "__sd")


# ---------------------------------------------------------------- E1-E5

def share(df: DataFrame, c: str, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Value / partition total."""
    by = list(by)
    tot = df.groupBy(*by).agg(F.sum(c).alias("__tot"))
    j = join_small(df, tot, by) if by else df.crossJoin(F.broadcast(tot))
    return j.withColumn(out or f"{c}_share", F.col(c) / F.col("__tot")).drop("__tot")


def rest(df: DataFrame, c: str, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Partition total minus own value."""
    by = list(by)
    tot = df.groupBy(*by).agg(F.sum(c).alias("__tot"))
    j = join_small(df, tot, by) if by else df.crossJoin(F.broadcast(tot))
    return j.withColumn(out or f"{c}_rest", F.col("__tot") - F.col(c)).drop("__tot")


def partition_counts(df: DataFrame, by: Sequence[str], distinct_of: str | None = None,
                     out: str = "n_in_group") -> DataFrame:
    """Partition count (or distinct count of a column) kept on each row (aggregate + join back)."""
    agg = F.count_distinct(distinct_of) if distinct_of else F.count(F.lit(1))
    tot = df.groupBy(*by).agg(agg.alias(out))
    return join_small(df, tot, list(by))


def partition_summary(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Several partition aggregates kept on each row: one aggregate, one join back."""
    return join_small(df, df.groupBy(*by).agg(*[v.alias(k) for k, v in aggs.items()]), list(by))


def since_first(df: DataFrame, key: str, ts: str, unit_hours: bool = True, out: str = "since_first") -> DataFrame:
    """Time since the first row of the partition (hours)."""
    first = df.groupBy(key).agg(F.min(ts).alias("__first"))
    j = df.join(first, key)
    scale = 3.6e9 if unit_hours else 8.64e10
    return j.withColumn(out, micros_between(ts, "__first") / scale).drop("__first")


def share_of_max(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """E5: value / global maximum (one-row aggregate, broadcast)."""
    mx = df.agg(F.max(c).alias("__mx"))
    return df.crossJoin(F.broadcast(mx)).withColumn(out or f"{c}_of_max", F.col(c) / F.col("__mx")).drop("__mx")


# ---------------------------------------------------------------- order statistics

def quantiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles (linear interpolation) as order statistics, long: by, name, statistic, value, n.

    Values are counted with map-side combining and ranked by two-level running sums, so no task holds a group's
    rows; NULLs are left out, NaN is the largest value.
    """
    by = list(by)
    counts = _value_counts(df, by, cols)
    return _order_statistics(counts.withColumn("__n", F.col("__n").cast("double")), [*by, "name"], probs)


def _value_counts(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols if c not in by]).unpivot(list(by), list(cols), "name", "__v")
    return long.filter(F.col("__v").isNotNull()).groupBy(*by, "name", "__v").agg(F.count(F.lit(1)).alias("__n"))


def grouped_quantiles(df: DataFrame, families: Mapping[str, Sequence[str]], cols: Sequence[str], probs: Mapping[str, float],
                      total: str | None = "TOTAL", sep: str = "-") -> DataFrame:
    """D9 over the overlapping families of :func:`grouped_levels` (levels, joint levels, TOTAL): family, group, name,
    statistic, value, n. Rows are counted once at the finest level; only counts are repeated per family."""
    levels = list(dict.fromkeys(c for cs in families.values() for c in cs))
    counts = _value_counts(df, levels, cols)
    group = {f: F.concat(*[F.lit(sep) if i % 2 else F.col(cs[i // 2]).cast("string") for i in range(2 * len(cs) - 1)]) for f, cs in families.items()}
    if total is not None:
        group[total] = F.lit(total)
    parts = F.array(*[F.struct(F.lit(f).alias("family"), g.alias("group")) for f, g in group.items()])
    rows = counts.withColumn("__f", F.explode(parts)).select("__f.*", "name", "__v", "__n")
    merged = rows.groupBy("family", "group", "name", "__v").agg(F.sum("__n").cast("double").alias("__n"))
    return _order_statistics(merged, ["family", "group", "name"], probs)


def _order_statistics(counts: DataFrame, key: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Quantiles of counted values (key, __v, __n)."""
    key = list(key)
    ranked = running_sums(counts, key, "__v", ["__n"], bucketed=True, prefix="__c")
    total = counts.groupBy(*key).agg(F.sum("__n").alias("__t"))
    rows = join_null_safe(ranked, total, key)
    aggs = []
    for name, p in probs.items():
        rank = (F.col("__t") - 1) * F.lit(float(p))
        for side, r in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            aggs.append(F.min(F.when(F.col("__c__n") > r, F.col("__v"))).alias(f"__{side}_{name}"))
    got = rows.groupBy(*key).agg(F.first("__t").alias("__t"), *aggs)
    parts = []
    for name, p in probs.items():
        rank = (F.col("__t") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        parts.append(F.struct(F.lit(name).alias("statistic"), (lo + (hi - lo) * (rank - F.floor(rank))).alias("value")))
    return got.select(*key, F.col("__t").cast("long").alias("n"), F.explode(F.array(*parts)).alias("__q")).select(*key, "__q.*", "n")


# ---------------------------------------------------------------- distributed running sums

def running_sums(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], descending: bool = False,
                 inclusive: bool = True, bucketed: bool = False, prefix: str = "cum_", how: str = "sum") -> DataFrame:
    """Running sums (``how="max"``: running maxima) of ``cols`` along ``order`` in each key; rows must be distinct
    per order value.

    ``bucketed=False``: one window per key (right when keys are many and small). ``True``: range partitions cut at
    sampled quantiles of (keys, order) and written once; their totals get an exclusive prefix over the small
    (key, partition) frame, and each partition finishes with its own window plus that offset. No task holds a large
    key, however skewed its axis. Exact: only the summation order differs.
    """
    from ..session import saved
    keys = list(keys)
    ordering = F.col(order).desc() if descending else F.col(order).asc()
    frame_end = 0 if inclusive else -1
    fold = F.sum if how == "sum" else F.max
    zero = F.lit(0.0) if how == "sum" else F.lit(None).cast("double")
    if not bucketed:
        w = Window.partitionBy(*keys).orderBy(ordering).rowsBetween(Window.unboundedPreceding, frame_end)
        return df.select("*", *[F.coalesce(fold(c).over(w), zero).alias(prefix + c) for c in cols])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = saved(df.repartitionByRange(n, *keys, order).withColumn("__b", F.spark_partition_id()), "running-ranges")
    tot = x.groupBy(*keys, "__b").agg(*[fold(c).alias(f"__t_{c}") for c in cols])
    wb = Window.partitionBy(*keys).orderBy(F.col("__b").desc() if descending else F.col("__b").asc()).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "__b", *[F.coalesce(fold(f"__t_{c}").over(wb), zero).alias(f"__o_{c}") for c in cols])
    same = F.lit(True)
    for k in [*keys, "__b"]:            # keys may be NULL
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"o.{k}"))
    x = x.alias("x").join(off.alias("o"), same).select("x.*", *[f"o.__o_{c}" for c in cols])
    wi = Window.partitionBy(*keys, "__b").orderBy(ordering).rowsBetween(Window.unboundedPreceding, frame_end)

    def both(c):
        own = F.coalesce(fold(c).over(wi), zero)
        return F.col(f"__o_{c}") + own if how == "sum" else F.greatest(F.col(f"__o_{c}"), own)
    return x.select(*df.columns, *[both(c).alias(prefix + c) for c in cols])
