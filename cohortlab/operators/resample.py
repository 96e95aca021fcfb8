"""g-computation, effect measures and percentile intervals; bootstrap draws are in ``vectors``."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

APPARENT = 0


def strata_frame(spark, strata: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Bounded stratum table: one row per stratum name with the values to assign to each column."""
    cols = sorted({c for a in strata.values() for c in a})
    rows = [(name, *[float(a.get(c, 0.0)) for c in cols]) for name, a in strata.items()]
    return spark.createDataFrame(rows, ", ".join(["stratum string"] + [f"`__s_{c}` double" for c in cols]))


def standardised_mean(df: DataFrame, keys: Sequence[str], strata: Mapping[str, Mapping[str, float]],
                      predict, weight: str | None = None, out: str = "risk") -> DataFrame:
    """G-computation — set everyone to each stratum, predict, average (weighted) per key and stratum.

    ``predict(frame) -> frame`` must add column ``pred`` computed from the (overwritten) columns.
    The stratum table is bounded (a handful of levels) and broadcast.
    """
    keys = list(keys)
    sf = strata_frame(df.sparkSession, strata)
    assigned = [c[4:] for c in sf.columns if c.startswith("__s_")]
    x = df.crossJoin(F.broadcast(sf))
    for c in assigned:
        x = x.withColumn(c, F.col(f"__s_{c}"))
    x = x.drop(*[f"__s_{c}" for c in assigned])
    p = predict(x)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return p.groupBy(*keys, "stratum").agg((F.sum(w * F.col("pred")) / F.sum(w)).alias(out))


def effects(risks: DataFrame, keys: Sequence[str], reference: str | Mapping[str, str], stratum: str = "stratum",
            risk: str = "risk", ref_group_col: str | None = None) -> DataFrame:
    """Risk difference, NNT (= 1/RD) and risk ratio against a reference stratum per key.

    ``reference``: the reference stratum name, or a mapping ``{group value: reference stratum}`` keyed by
    ``ref_group_col`` (e.g. abo -> 'aboO', rh -> 'rh0').
    """
    keys = list(keys)
    if isinstance(reference, str):
        ref = risks.filter(F.col(stratum) == reference)
    else:
        cond = None
        for g, s in reference.items():
            c = (F.col(ref_group_col) == g) & (F.col(stratum) == s)
            cond = c if cond is None else cond | c
        ref = risks.filter(cond)
    ref = ref.select(*keys, F.col(risk).alias("reference_risk"))
    j = risks.join(ref, keys) if keys else risks.crossJoin(F.broadcast(ref))
    rd = F.col(risk) - F.col("reference_risk")
    # NNT is undefined (NULL) for the reference stratum itself (RD = 0)
    return j.withColumn("risk_difference", rd).withColumn("nnt", F.try_divide(F.lit(1.0), rd)) \
        .withColumn("relative_risk", F.try_divide(F.col(risk), F.col("reference_risk")))


def percentile_ci(boot: DataFrame, keys: Sequence[str], cols: Sequence[str], iter_col: str = "bootstrap_iteration",
                  level: float = 0.95) -> DataFrame:
    """Apparent estimate + percentile interval (linear interpolation, R type 7) over iterations >= 1.

    A failed iteration has NULL in the first of ``cols`` and stays out of the interval: ``n_boot_used`` and
    ``n_failed`` count both kinds. A group holds one row per iteration."""
    keys = list(keys)
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    app = boot.filter(F.col(iter_col) == APPARENT).select(*keys, *cols)
    ci = boot.filter(F.col(iter_col) != APPARENT).groupBy(*keys).agg(
        *[F.percentile(F.col(c), lo).alias(f"{c}_conf_low") for c in cols],
        *[F.percentile(F.col(c), hi).alias(f"{c}_conf_high") for c in cols],
        F.count(cols[0]).alias("n_boot_used"), F.count_if(F.col(cols[0]).isNull()).alias("n_failed"))
    return app.join(ci, keys, "left") if keys else app.crossJoin(ci)
