"""Column-expression helpers.

Everything returns a ``Column`` built from ``pyspark.sql.functions``; nothing here runs Python per row.
"""
from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


# ---------------------------------------------------------------- predicates

def like_any(c, patterns: Iterable[str], case_insensitive: bool = False) -> Column:
    """True when ``c`` matches any SQL LIKE pattern (Q1: optional case folding on both sides)."""
    c = col(c)
    pats = list(patterns)
    if not pats:
        return F.lit(False)
    if case_insensitive:
        conds = [F.lower(c).like(p.lower()) for p in pats]
    else:
        conds = [c.like(p) for p in pats]
    out = conds[0]
    for x in conds[1:]:
        out = out | x
    return out


def consistent_times(exit_col, entry_col) -> Column:
    """Exit >= entry, with a missing exit allowed."""
    return col(exit_col).isNull() | (col(exit_col) >= col(entry_col))


# ---------------------------------------------------------------- recodes

def recode(c, mapping: Sequence[tuple] | Mapping, default=None, kind: str = "eq") -> Column:
    """Ordered multi-branch recode.

    ``kind='eq'``: equality branches, ``'like'``: LIKE patterns, ``'in'``: each key is a tuple of values,
    ``'expr'``: each key is already a boolean Column. Branch order is kept (Q2). Without a default an
    unmatched value gives NULL, as a CASE without ELSE.
    """
    c = col(c)
    items = list(mapping.items()) if isinstance(mapping, Mapping) else list(mapping)
    out = None
    for key, value in items:
        if kind == "eq":
            cond = c == F.lit(key)
        elif kind == "like":
            cond = like_any(c, key if isinstance(key, (list, tuple)) else [key])
        elif kind == "in":
            cond = c.isin(list(key))
        elif kind == "expr":
            cond = key
        else:
            raise ValueError(kind)
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    if out is None:
        return F.lit(default)
    if default is not None:
        out = out.otherwise(default if isinstance(default, Column) else F.lit(default))
    return out


def map_recode(c, mapping: Mapping, default=None) -> Column:
    """Named-vector lookup via a literal map; unmatched -> default (or the input when default='keep')."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    looked = m[col(c)]
    if default == "keep":
        return F.coalesce(looked, col(c))
    return F.coalesce(looked, F.lit(default)) if default is not None else looked


def bool01(c) -> Column:
    """Boolean -> 0/1 integer (NULL stays NULL)."""
    return col(c).cast("int")


# ---------------------------------------------------------------- text

def extract_or_null(c, pattern: str, group: int = 0) -> Column:
    """Regex extract returning NULL (not '') when there is no match."""
    c = col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def multi_replace(c, pairs: Sequence[tuple[str, str]], regex: bool = True) -> Column:
    """Chained replacements, applied in the given order."""
    out = col(c)
    for pat, rep in pairs:
        out = F.regexp_replace(out, pat, rep) if regex else F.replace(out, F.lit(pat), F.lit(rep))
    return out


def sentence_case(c) -> Column:
    """First character upper, the rest lower."""
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def squish(c) -> Column:
    """Trim and collapse runs of whitespace."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def drop_check_digit(code) -> Column:
    """T4/C3: 'NNNN-D' code -> integer without the trailing check digit (NULL when not numeric)."""
    c = col(code)
    head = c.substr(F.lit(1), F.char_length(c) - 2)
    return F.when(~c.rlike("[A-Za-z]"), head.try_cast("long"))


def lab_value(c, strip: str = "<>%") -> Column:
    """J6 text result -> decimal(10,5): only values matching ``^[<>%0-9.]+$`` are kept (Q9, Q10)."""
    c = col(c)
    cleaned = c
    for ch in strip:
        cleaned = F.replace(cleaned, F.lit(ch), F.lit(""))
    return F.when(c.rlike(r"^[<>%0-9.]+$"), cleaned.try_cast("decimal(10,5)"))


def null_tokens(c, tokens: Iterable[str] = ("(null)",)) -> Column:
    """Literal missing tokens -> NULL."""
    c = col(c)
    return F.when(~c.isin(list(tokens)) | c.isNull(), c)


def zero_date(c) -> Column:
    """MySQL zero-date text -> NULL, otherwise parsed date."""
    c = col(c)
    return F.try_to_date(F.nullif(c.cast("string"), F.lit("0000-00-00")))


# ---------------------------------------------------------------- dates and math

def micros_between(later, earlier) -> Column:
    """Wall-clock difference in microseconds, independent of the session time zone (no DST shifts):
    both sides are taken as TIMESTAMP_NTZ, which the driver tables already are."""
    return F.timestamp_diff("MICROSECOND", col(earlier).cast("timestamp_ntz"), col(later).cast("timestamp_ntz"))


def epoch_micros(c) -> Column:
    """Wall-clock microseconds since 1970-01-01 (session-time-zone independent)."""
    return micros_between(c, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def hours_between(later, earlier) -> Column:
    """(later - earlier) in hours as double."""
    return micros_between(later, earlier) / 3.6e9


def days_between(later, earlier) -> Column:
    return micros_between(later, earlier) / 8.64e10


def age_years(birth, as_of, kind: str = "days365") -> Column:
    """Q11: days/365 (SQL scripts) or whole calendar years (R notebooks)."""
    if kind == "days365":
        return F.datediff(F.to_date(col(as_of)), F.to_date(col(birth))) / 365.0
    if kind == "calendar":
        return F.floor(F.months_between(F.to_date(col(as_of)), F.to_date(col(birth))) / 12.0)
    raise ValueError(kind)


def interval_years(start, end) -> Column:
    """Fractional years of the interval [start, end] as whole years plus the elapsed share of the next
    year (lubridate ``time_length(interval(start, end), "years")``)."""
    s0, e0 = F.to_date(col(start)), F.to_date(col(end))
    n0 = F.floor(F.months_between(e0, s0) / 12).cast("int")
    n = F.when(F.add_months(s0, n0 * 12) > e0, n0 - 1).otherwise(n0)
    anchor = F.add_months(s0, n * 12)
    nxt = F.add_months(s0, (n + 1) * 12)
    return n + F.datediff(e0, anchor) / F.datediff(nxt, anchor)


def pmin_na(*cols) -> Column:
    """T10 with Q13: row-wise minimum that is NULL when any input is NULL (R ``pmin``)."""
    cs = [col(c) for c in cols]
    any_null = cs[0].isNull()
    for c in cs[1:]:
        any_null = any_null | c.isNull()
    return F.when(~any_null, F.least(*cs))


def round_half_even(c, digits: int = 0) -> Column:
    """Q15: R's round() goes to the even digit on exact ties."""
    return F.bround(col(c), digits)


def across(df: DataFrame, cols: Iterable[str], fn) -> DataFrame:
    """Apply ``fn(Column) -> Column`` to several columns, keeping names and order."""
    cols = set(cols)
    return df.select(*[fn(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def cols_like(df: DataFrame, prefix: str | None = None, suffix: str | None = None,
              contains: str | None = None) -> list[str]:
    """Column choice by name."""
    out = []
    for c in df.columns:
        if prefix is not None and not c.startswith(prefix):
            continue
        if suffix is not None and not c.endswith(suffix):
            continue
        if contains is not None and contains not in c:
            continue
        out.append(c)
    return out
