"""Reshape operators.

Pivots always take their level list from the caller so Spark does not run an extra job to discover
them, and the width of the output is known at plan time.
"""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def widen(df: DataFrame, ids: Sequence[str], names: str, values: str | Sequence[str], levels: Sequence,
          fill=None, agg: str = "first") -> DataFrame:
    """Long -> wide (``pivot`` with explicit levels), missing cells filled with ``fill``.

    Several value columns give ``<level>_<value>`` columns.
    """
    vals = [values] if isinstance(values, str) else list(values)
    fn = {"first": F.first, "sum": F.sum, "max": F.max, "min": F.min}[agg]
    g = df.groupBy(*ids).pivot(names, list(levels))
    if len(vals) == 1:
        out = g.agg(fn(vals[0]))
    else:
        out = g.agg(*[fn(v).alias(v) for v in vals])  # columns named <level>_<value>
    if fill is not None:
        out = out.fillna(fill)
    return out


def lengthen(df: DataFrame, ids: Sequence[str], cols: Sequence[str] | None = None, names_to: str = "name",
             values_to: str = "value") -> DataFrame:
    """Wide -> long with ``unpivot`` (one scan for all columns); value types are unified."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), cols, names_to, values_to)


def pasted(cols: Sequence[str], sep: str) -> Column:
    """Columns joined by ``sep``, NULL if any is."""
    parts = [F.lit(sep) if i % 2 else F.col(cols[i // 2]).cast("string") for i in range(2 * len(cols) - 1)]
    return F.concat(*parts)


def unite(df: DataFrame, out: str, cols: Sequence[str], sep: str = "_", remove: bool = True) -> DataFrame:
    """Paste columns together; a NULL piece makes the result NULL."""
    res = df.withColumn(out, pasted(cols, sep))
    return res.drop(*[c for c in cols if c != out]) if remove else res


def split_cols(df: DataFrame, c: str, names: Sequence[str], sep: str = "_",
               types: Mapping[str, str] | None = None, remove: bool = True) -> DataFrame:
    """Split one column into several, optionally typed (``try_cast``)."""
    parts = F.split(F.col(c), re.escape(sep))
    out = df
    for i, n in enumerate(names):
        v = parts.getItem(i)
        if types and n in types:
            v = v.try_cast(types[n])
        out = out.withColumn(n, v)
    return out.drop(c) if remove and c not in names else out


def split_rows(df: DataFrame, c: str, sep: str) -> DataFrame:
    """One row per piece of a delimited value."""
    return df.withColumn(c, F.explode(F.split(F.col(c), re.escape(sep))))


def one_hot(df: DataFrame, c: str, levels: Sequence, prefix: str | None = None, sep: str = "_",
            dtype: str = "double") -> DataFrame:
    """Full one-hot columns ``<prefix>_<level>`` (all levels)."""
    p = c if prefix is None else prefix
    return df.select("*", *[(F.col(c) == F.lit(lv)).cast(dtype).alias(f"{p}{sep}{lv}") for lv in levels])


def dummy(df: DataFrame, c: str, levels: Sequence, ref=None, prefix: str | None = None, sep: str = "_",
          drop: bool = True, dtype: str = "double") -> DataFrame:
    """Reference-coded dummies (``ref`` defaults to the first level, as after re-levelling)."""
    ref = levels[0] if ref is None else ref
    p = c if prefix is None else prefix
    out = df.select("*", *[(F.col(c) == F.lit(lv)).cast(dtype).alias(f"{p}{sep}{lv}") for lv in levels if lv != ref])
    return out.drop(c) if drop else out


def nest(df: DataFrame, keys: Sequence[str], name: str = "data") -> DataFrame:
    """Rows -> list column per key (only for bounded groups; models use group keys instead)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias(name))


def unnest(df: DataFrame, name: str = "data") -> DataFrame:
    """List column of structs -> rows and columns."""
    keys = [c for c in df.columns if c != name]
    return df.select(*keys, F.inline(name))


def transpose(df: DataFrame, id_col: str, ids: Sequence, names_to: str = "name") -> DataFrame:
    """Small summary transpose: the rows with the declared ``ids`` become columns (unpivot -> pivot)."""
    vals = [c for c in df.columns if c != id_col]
    long = df.select(id_col, *[F.col(c).cast("string").alias(c) for c in vals]).unpivot([id_col], vals, names_to, "__v")
    return long.groupBy(names_to).pivot(id_col, list(ids)).agg(F.first("__v"))


def order_by_levels(df: DataFrame, c: str, levels: Sequence, desc: bool = False, extra: Sequence = ()) -> DataFrame:
    """Sort by a declared level order (unknown levels last)."""
    rank = level_rank(c, levels)
    return df.orderBy(rank.desc() if desc else rank.asc(), *extra)


def level_rank(c, levels: Sequence) -> Column:
    """Explicit order column for a categorical."""
    m = F.create_map(*[x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(m[F.col(c) if isinstance(c, str) else c], F.lit(len(levels)))


def levels(df: DataFrame, c: str) -> list:
    """Ordered distinct values of a low-cardinality column (collected once, for pivots/one-hot)."""
    return [r[0] for r in df.select(c).distinct().orderBy(c).collect()]


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Positional rename."""
    return df.toDF(*names)
