"""Joins, set operations and row-level relational operators.

Scale notes
-----------
* Vocabulary / rule / configuration sides are broadcast only behind a size check
  (:func:`checked_broadcast`); beyond the bound the join is left to sort-merge + AQE (which may still
  switch to a broadcast from the measured shuffle size, and splits skewed partitions).
* "One row per key" uses an aggregate (``min`` of a struct) instead of ``row_number`` over a window,
  so partial aggregation runs map-side and a hot key does not land whole in one sort task.
"""
from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import micros_between

#: default byte bound for broadcasting on the optimizer's size estimate
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer size estimate of the plan (an upper bound for scans + filters/projections; no job)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString()))
    except Exception:  # noqa: BLE001 - no estimate available
        return 1 << 62


def checked_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only behind the optimizer's size estimate, else no hint (AQE re-plans from the real size)."""
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Join a (usually small) side; broadcast behind a size check, sort-merge (+AQE) beyond it."""
    return big.join(checked_broadcast(small, max_bytes), on=on, how=how)


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys in which NULL equals NULL; ``on=[]`` pairs with a one-row frame."""
    if not on:
        return left.join(right, how=how) if how != "inner" else left.crossJoin(right)
    left, right = left.alias("__l"), right.alias("__r")
    same = F.col(f"__l.`{on[0]}`").eqNullSafe(F.col(f"__r.`{on[0]}`"))
    for k in on[1:]:
        same = same & F.col(f"__l.`{k}`").eqNullSafe(F.col(f"__r.`{k}`"))
    rest = [c for c in right.columns if c not in on] if how not in ("left_semi", "left_anti") else []
    return left.join(right, same, how).select("__l.*", *[f"__r.`{c}`" for c in rest])


# ---------------------------------------------------------------- C3, C8, C9, C10


def semi(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """``IN (subquery)``; the key side is deduplicated first (partial aggregation), so a key repeated
    in a third of the rows reaches the join once."""
    on_list = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*on_list).distinct(), on=on_list, how="left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """``NOT IN (subquery)`` (Q6).

    A NULL key on the inner side would make SQL ``NOT IN`` return no rows at all; the reference's
    key columns are never NULL there, so NULL keys are dropped from the inner side and a plain
    (scalable, shuffle-able) anti join is used instead of the broadcast-only null-aware one.
    """
    on_list = [on] if isinstance(on, str) else list(on)
    inner = keys.select(*on_list).dropna().distinct()  # one row per key before the join (skew-safe)
    return df.join(inner, on=on_list, how="left_anti")


def keep_consistent(df: DataFrame, key: str, cols: Sequence[str], policy: str = "distinct_non_null") -> DataFrame:
    """Keep persons whose typed values agree (Q4, Q5) — one aggregate, one pass over ``df``.

    ``distinct_non_null``: ``COUNT(DISTINCT a, b) = 1`` (tuples with a NULL are not counted; all distinct
    rows of the kept persons are returned). The per-person set of distinct value tuples is bounded by the
    product of the categories' levels, so collecting it per key is safe. ``single_row``: drop persons
    with more than one row.
    """
    tup = F.struct(*[F.col(c) for c in cols])
    if policy == "distinct_non_null":
        g = df.groupBy(key).agg(F.collect_set(tup).alias("__s"))

        def complete(s):
            ok = F.lit(True)
            for c in cols:
                ok = ok & s[c].isNotNull()
            return ok
        n = F.size(F.filter(F.col("__s"), complete))
        return g.filter(n == 1).select(key, F.inline("__s"))
    if policy == "single_row":
        g = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max(tup).alias("__r"))
        return g.filter(F.col("__n") == 1).select(key, *[F.col(f"__r.{c}").alias(c) for c in cols])
    raise ValueError(policy)


# ---------------------------------------------------------------- C5-C7 time-window joins

def entry_time(first: DataFrame, intervals: DataFrame, key: str, t: str, start: str,
               max_lag_hours: float = 96.0, out: str = "cohort_entry_time") -> DataFrame:
    """Interval start when ``t`` falls in [start, start + max_lag], else ``t``; min over intervals.

    Equivalent to ``MIN(IF(t >= start AND t - start <= lag, start, t))`` after a LEFT join, computed as an
    INNER join (AQE can split a person with a huge number of intervals — it cannot on the outer side of a
    left join) whose one-row-per-person minimum is joined back and defaulted to ``t``.
    """
    j = first.select(key, t).join(intervals.select(key, start), key, "inner")
    lag_ok = (F.col(t) >= F.col(start)) & (micros_between(t, start) <= F.lit(int(max_lag_hours * 3.6e9)))
    m = j.groupBy(key).agg(F.min(F.when(lag_ok, F.col(start)).otherwise(F.col(t))).alias("__m"))
    return first.select(key, t).join(m, key, "left").select(key, F.coalesce("__m", t).alias(out))


def max_censor(entries: DataFrame, intervals: DataFrame, key: str, entry: str, start: str, end: str,
               horizon_days: int = 10, out: str = "max_censor_time") -> DataFrame:
    """End of an interval spanning entry + horizon, else entry + horizon; max over intervals.

    Inner join + per-person maximum joined back (skew-splittable, see :func:`entry_time`)."""
    plus = F.col(entry) + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(horizon_days))
    base = entries.select(key, entry).withColumn("__plus", plus)
    j = base.join(intervals.select(key, start, end), key, "inner")
    spans = (F.col(start) <= F.col("__plus")) & (F.col(end) > F.col("__plus"))
    m = j.groupBy(key).agg(F.max(F.when(spans, F.col(end)).otherwise(F.col("__plus"))).alias("__m"))
    return base.join(m, key, "left").select(key, F.coalesce("__m", "__plus").alias(out))


def events_between(bounds: DataFrame, events: DataFrame, key: str, lo: str, hi: str, ev_time: str,
                   how: str = "inner") -> DataFrame:
    """Events whose time lies in the per-row [lo, hi] (equi-key + range residual)."""
    e = events.alias("__e")
    b = bounds.alias("__b")
    cond = (F.col(f"__b.{key}") == F.col(f"__e.{key}")) & (F.col(f"__e.{ev_time}") >= F.col(f"__b.{lo}")) & \
           (F.col(f"__e.{ev_time}") <= F.col(f"__b.{hi}"))
    other = [c for c in events.columns if c != key and c not in bounds.columns]
    return b.join(e, cond, how).select("__b.*", *[F.col(f"__e.{c}") for c in other])


# ---------------------------------------------------------------- C11-C16

def assemble(base: DataFrame, key: str, inner: Iterable[DataFrame] = (), left: Iterable[DataFrame] = ()) -> DataFrame:
    """C11: star assembly; each side table must already be one row per key."""
    out = base
    for d in inner:
        out = out.join(d, key, "inner")
    for d in left:
        out = out.join(d, key, "left")
    return out


def descendants(events: DataFrame, code_col: str, closure: DataFrame, ancestors: Sequence[int] | DataFrame,
                anc_col: str = "ancestor_concept_id", desc_col: str = "descendant_concept_id",
                label_col: str | None = None) -> DataFrame:
    """Events whose code is a descendant of any ancestor, in one pass over the events.

    ``ancestors`` is a list of ids or a frame ``(ancestor_concept_id[, label])``; the closure subset is
    joined to the events once (checked broadcast), so many phenotypes share one event scan.
    """
    if isinstance(ancestors, DataFrame):
        sub = closure.join(ancestors, anc_col, "inner")
    else:
        sub = closure.filter(F.col(anc_col).isin(list(ancestors)))
    keep = [desc_col, anc_col] + ([label_col] if label_col and label_col in sub.columns else [])
    sub = sub.select(*keep).distinct()
    return events.join(checked_broadcast(sub), events[code_col] == sub[desc_col], "inner").drop(desc_col)


def mapped_codes(closure: DataFrame, relationship: DataFrame, concept: DataFrame, ancestors: Sequence[int] | DataFrame,
                 relationships: Sequence[str] = ("Included in map from", "Mapped from"),
                 vocabulary: str = "ICD10CM") -> DataFrame:
    """Closure -> relationship -> concept folded into one small ``(ancestor, concept_code)`` list."""
    if isinstance(ancestors, DataFrame):
        sub = closure.join(ancestors, "ancestor_concept_id")
    else:
        sub = closure.filter(F.col("ancestor_concept_id").isin(list(ancestors)))
    rel = relationship.filter(F.col("relationship_id").isin(list(relationships)))
    con = concept.filter(F.col("vocabulary_id") == vocabulary).select("concept_id", "concept_code")
    return (sub.join(rel, sub["descendant_concept_id"] == rel["concept_id_1"])
               .join(con, rel["concept_id_2"] == con["concept_id"])
               .select(*[c for c in sub.columns if c != "descendant_concept_id"], "concept_code").distinct())


def match_codes(events: DataFrame, code: Column, codes: DataFrame, code_col: str, label: str = "matched") -> DataFrame:
    """Every event with ``label`` true if its (normalised) code is one of ``codes``.

    The code is computed once and the join is an equi-join on a distinct code list (checked broadcast), so matched
    events and the quality report on unmatched ones (:func:`match_report`) come from the same pass."""
    known = codes.select(F.col(code_col).alias("__code")).filter("__code is not null").distinct().withColumn("__hit", F.lit(True))
    out = events.withColumn("__code", code).join(checked_broadcast(known), "__code", "left")
    return out.withColumn(label, F.coalesce("__hit", F.lit(False))).drop("__hit")


def match_report(matched: DataFrame, label: str = "matched") -> DataFrame:
    """Rows, events without any code, and distinct codes on both sides of :func:`match_codes`."""
    return matched.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("__code").isNull()).alias("n_without_code"),
                                      F.count_distinct("__code").alias("n_codes"))


def with_config(df: DataFrame, config: Sequence[Mapping]) -> DataFrame:
    """C14: data x configuration grid; the configuration is a list of the caller's, exploded on each row."""
    rows = [F.struct(*(F.lit(v).alias(k) for k, v in c.items())) for c in config]
    return df.withColumn("__c", F.explode(F.array(*rows))).select(*df.columns, "__c.*")


def bind_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a single-row result to every row; no row gives no rows, more than one is an error."""
    packed = one_row.agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*one_row.columns)).alias("__r"))
    checked = packed.filter("__n > 0").select(
        F.when(F.col("__n") == 1, F.col("__r")).otherwise(F.raise_error(F.lit("more than one row to bind"))).alias("__r"))
    return df.crossJoin(F.broadcast(checked)).select(*df.columns, "__r.*")     # one row by the aggregate


# ---------------------------------------------------------------- B14, B17, B18, H1, H2

def stratify(df: DataFrame, rules: Mapping[str, Column | str], name: str = "outcome") -> DataFrame:
    """Replicate each row once per rule it passes (one scan, ``explode`` of passed rule names)."""
    names = [F.when(r if isinstance(r, Column) else F.expr(r), F.lit(k)) for k, r in rules.items()]
    return df.withColumn(name, F.explode(F.array_compact(F.array(*names))))


def distinct_by(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One full row per key, the first by ``order`` (then by the remaining columns) — deterministic.

    Implemented as ``min(struct(order..., rest...))`` so partial aggregation runs map-side.
    """
    order = list(order or [])
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("__r")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in order + rest]) \
        .select(*df.columns)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """H1: UNION ALL / row-bind; missing columns are NULL-filled."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """H2: UNION (distinct)."""
    return union_all(frames).distinct()
