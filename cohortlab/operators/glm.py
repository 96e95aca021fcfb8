"""Grouped regression models.

Batched IRLS for many logistic models at once
---------------------------------------------
Rows are first compressed to covariate patterns ``(keys, x...) -> (y_sum, n)`` (one partial-aggregated
shuffle). Each IRLS iteration is then ONE Spark job: an aggregate over the patterns grouped by model key gives the
deviance at the current coefficients and the normal equations X'WX, X'Wz, and the p x p systems are solved as arrays
in the tasks where the keys' sums arrive. Coefficients, deviances and convergence flags are a DataFrame (one row per
key) between iterations; the driver learns how many keys are still going and nothing else, so the number of models is
not bounded by the driver. The join of patterns and coefficients is broadcast only if Spark finds the written state
below its threshold.

Conventions follow R ``glm(family = binomial)`` on person rows: start from ``mustart = (y + 0.5) / 2``,
convergence ``|dev - dev_old| / (|dev| + 0.1) < 1e-8``, at most 25 iterations, Bernoulli deviance,
aliased (rank-deficient) columns dropped from the right in the given term order (K9, Q22).
"""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from .relational import checked_broadcast, join_null_safe

INTERCEPT = "(Intercept)"
_EPS = 2.220446049250313e-16
_THRESH = 30.0  # beyond this |eta| the inverse logit link is held at its value there


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows without a missing (NULL or NaN) value in ``cols``: what a model is fitted on."""
    return df.dropna(how="any", subset=list(dict.fromkeys(cols)))


def dropped_cases(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per key: rows used and rows left out for a missing value (one aggregate)."""
    types = dict(df.dtypes)
    missing = [F.col(c).isNull() | (F.isnan(c) if types[c] in ("double", "float") else F.lit(False)) for c in cols]
    bad = F.greatest(F.lit(0), *[m.cast("int") for m in missing])
    return df.groupBy(*keys).agg(F.sum(1 - bad).cast("long").alias("n_used"), F.sum(bad).cast("long").alias("n_dropped"))


def compress(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], weight: str | None = None) -> DataFrame:
    """Covariate-pattern compression of the complete rows: ``(keys, xs) -> __y (sum of y*w), __n (sum of w)``."""
    df = complete_cases(df, [y, *xs, *([weight] if weight else [])])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(*keys, *xs).agg(F.sum(F.col(y).cast("double") * w).alias("__y"), F.sum(w).alias("__n"))


def _gram_aggs(xcols: Sequence[str], wcol: Column, zcol: Column | None) -> list[Column]:
    cols = [F.lit(1.0)] + [F.col(c).cast("double") for c in xcols]
    out = []
    p = len(cols)
    for i in range(p):
        for j in range(i, p):
            out.append(F.sum(wcol * cols[i] * cols[j]).alias(f"__g_{i}_{j}"))
    if zcol is not None:
        for i in range(p):
            out.append(F.sum(zcol * cols[i]).alias(f"__r_{i}"))
    return out


def alias_mask(gram: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """K9: sequential sweep in column order; a column is aliased when its residual sum of squares after
    projection on the kept columns is <= tol * its own sum of squares (or it is all zero)."""
    p = gram.shape[0]
    keep = np.zeros(p, dtype=bool)
    for j in range(p):
        gjj = gram[j, j]
        if gjj <= 0:
            continue
        kk = np.where(keep)[0]
        if len(kk) == 0:
            keep[j] = True
            continue
        gkk = gram[np.ix_(kk, kk)]
        gkj = gram[kk, j]
        try:
            sol = np.linalg.solve(gkk, gkj)
        except np.linalg.LinAlgError:
            sol = np.linalg.lstsq(gkk, gkj, rcond=None)[0]
        resid = gjj - gkj @ sol
        if resid > tol * gjj:
            keep[j] = True
    return keep


def alias_masks(gram: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """:func:`alias_mask` of many Gram matrices (n, p, p) at once."""
    n, p = gram.shape[:2]
    keep = np.zeros((n, p), dtype=bool)
    for j in range(p):
        own = gram[:, j, j]
        cross = np.where(keep, gram[:, :, j], 0.0)
        resid = own - (cross * masked_solve(gram, cross, keep)).sum(axis=1)
        keep[:, j] = (own > 0) & (resid > tol * own)
    return keep


def masked_solve(gram: np.ndarray, rhs: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Solutions of many systems on their kept columns, 0 elsewhere."""
    both = keep[:, :, None] & keep[:, None, :]
    system = np.where(both, gram, 0.0) + np.eye(gram.shape[1]) * ~keep[:, None, :]
    rhs = np.where(keep, rhs, 0.0)
    try:
        return np.linalg.solve(system, rhs[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return (np.linalg.pinv(system) @ rhs[..., None])[..., 0]


def masked_se(gram: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Square roots of the inverse's diagonal on the kept columns."""
    both = keep[:, :, None] & keep[:, None, :]
    system = np.where(both, gram, 0.0) + np.eye(gram.shape[1]) * ~keep[:, None, :]
    try:
        cov = np.linalg.inv(system)
    except np.linalg.LinAlgError:
        cov = np.linalg.pinv(system)
    return np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0.0))


def _grams(batch: pa.RecordBatch, p: int) -> np.ndarray:
    """The __g_i_j columns of a batch as symmetric matrices; sums over no rows are 0."""
    out = np.zeros((batch.num_rows, p, p))
    for i in range(p):
        for j in range(i, p):
            out[:, i, j] = out[:, j, i] = _doubles(batch, f"__g_{i}_{j}")
    return out


def _doubles(batch: pa.RecordBatch, c: str) -> np.ndarray:
    return batch.column(c).fill_null(0.0).to_numpy(zero_copy_only=False)


def _vectors(batch: pa.RecordBatch, c: str, width: int) -> np.ndarray:
    return batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).copy()


def _lists(m: np.ndarray) -> pa.Array:
    n, k = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(m).ravel()))


_LOGIT_STATE = ["__beta array<double>", "__keep array<boolean>", "__gram array<double>", "__dev_old double", "__dev_now double", "__nobs double",
                "__going boolean", "__steps int"]


def logit_grouped(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], weight: str | None = None,
                  max_iter: int = 25, epsilon: float = 1e-8, compressed: bool = False,
                  persist: bool = True) -> tuple[DataFrame, DataFrame]:
    """K6/K7: logistic regression per model key. Returns ``(coefficients, fits)`` DataFrames.

    coefficients: keys, term, estimate, std_error, statistic, p_value (aliased terms omitted, as in tidy())
    fits: keys, deviance, df_residual, n_obs, rank, converged, iterations, aic
    ``xs`` order is the term order used to drop aliased columns from the right. Keys may be NULL.
    """
    from ..session import drop_saved, run_by_value, saved, saved_counting
    keys, xs = list(keys), list(xs)
    pat = df if compressed else compress(df, keys, y, xs, weight)
    if persist:     # re-read by every iteration: written once to the shared folder
        pat = saved(pat, "logit-patterns")
    p = len(xs) + 1
    terms = [INTERCEPT] + xs
    key_ddl = "".join(f"`{n}` {t}, " for n, t in _key_types(pat, keys))
    state_cols = [c.split()[0] for c in _LOGIT_STATE]
    run_by_value(__name__)

    def rows(batch: pa.RecordBatch, *cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *cols], names=[*keys, *state_cols])

    def start(batches):
        for batch in batches:
            n = batch.num_rows
            gram = _grams(batch, p)
            keep = alias_masks(gram)
            beta = masked_solve(gram, np.stack([_doubles(batch, f"__r_{i}") for i in range(p)], axis=1), keep)
            dev = pa.array(_doubles(batch, "__dev"))
            yield rows(batch, _lists(beta), _lists(keep), _lists(gram.reshape(n, -1)), dev, dev, pa.array(_doubles(batch, "__nobs_0")),
                       pa.array(np.ones(n, bool)), pa.array(np.zeros(n, np.int32)))

    def step(batches):
        """The state of keys still going with the sums at their coefficients -> the next state."""
        for batch in batches:
            n = batch.num_rows
            old, keep = _vectors(batch, "__beta", p), _vectors(batch, "__keep", p).astype(bool)
            gram_used = _vectors(batch, "__gram", p * p)
            dev_old, dev = _doubles(batch, "__dev_old"), _doubles(batch, "__dev")
            on = ~(np.abs(dev - dev_old) / (np.abs(dev) + 0.1) < epsilon)
            gram = np.where(on[:, None, None], _grams(batch, p), np.eye(p))
            new = masked_solve(gram, np.stack([_doubles(batch, f"__r_{i}") for i in range(p)], axis=1), keep)
            steps = batch.column("__steps").to_numpy(zero_copy_only=False) + 1
            yield rows(batch, _lists(np.where(on[:, None], new, old)), _lists(keep), _lists(np.where(on[:, None], gram.reshape(n, -1), gram_used)),
                       pa.array(np.where(on, dev, dev_old)), pa.array(dev), batch.column("__nobs"), pa.array(on), pa.array(steps.astype(np.int32)))

    def errors(batches):
        for batch in batches:
            keep = _vectors(batch, "__keep", p).astype(bool)
            se = masked_se(_vectors(batch, "__gram", p * p).reshape(-1, p, p), keep)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("__beta"), batch.column("__keep"), _lists(se)],
                                             names=[*keys, "__beta", "__keep", "__se"])

    # iteration 0 at mustart = (y + 0.5)/2 per person: w = 3/16 per person, z = +-(logit(3/4) + 4/3)
    z0 = math.log(3.0) + 4.0 / 3.0
    w0 = F.lit(0.1875) * F.col("__n")
    wz0 = F.lit(0.1875 * z0) * (2.0 * F.col("__y") - F.col("__n"))
    dev0 = F.lit(-2.0 * math.log(0.75)) * F.col("__n")
    agg0 = pat.groupBy(*keys).agg(*_gram_aggs(xs, w0, wz0), F.sum(dev0).alias("__dev"), F.sum("__n").alias("__nobs_0"))
    ddl = key_ddl + ", ".join(_LOGIT_STATE)
    state = saved(agg0.mapInArrow(start, ddl), "logit-state")
    for _ in range(max_iter):
        now = state.filter("__going").select(*keys, *[F.element_at("__beta", i + 1).alias(f"__b_{i}") for i in range(p)])
        eta = F.lit(0.0)
        for i in range(p):
            xi = F.lit(1.0) if i == 0 else F.col(xs[i - 1]).cast("double")
            eta = eta + F.col(f"__b_{i}") * xi
        mu = 1.0 / (1.0 + F.exp(-F.greatest(F.least(F.col("__eta"), F.lit(_THRESH)), F.lit(-_THRESH))))
        w = F.col("__n") * F.col("__mu") * (1.0 - F.col("__mu"))
        wz = F.col("__w") * F.col("__eta") + (F.col("__y") - F.col("__n") * F.col("__mu"))
        dev = -2.0 * (F.when(F.col("__y") > 0, F.col("__y") * F.log("__mu")).otherwise(0.0)
                      + F.when(F.col("__n") - F.col("__y") > 0, (F.col("__n") - F.col("__y")) * F.log(1.0 - F.col("__mu"))).otherwise(0.0))
        # working weight, response and deviance as columns first: the p(p+1)/2 sums then multiply plain columns
        # instead of each re-expanding the p-term linear predictor (small generated code)
        at = join_null_safe(pat, now, keys).withColumn("__eta", eta).withColumn("__mu", mu).withColumn("__w", w)
        rowwise = at.select(*keys, *xs, "__w", wz.alias("__wz"), dev.alias("__dv"))
        sums = rowwise.groupBy(*keys).agg(*_gram_aggs(xs, F.col("__w"), F.col("__wz")), F.sum("__dv").alias("__dev"))
        # the written state is the side with a known size; keys that are done are passed on as they are
        met = join_null_safe(sums, state.filter("__going"), keys)
        new, seen = saved_counting(met.mapInArrow(step, ddl).unionByName(state.filter(~F.col("__going"))), "logit-state", going=F.count_if("__going"))
        drop_saved(state)
        state = new
        if not seen["going"]:
            break
    rank = F.size(F.filter("__keep", lambda k: k))
    fits = state.select(*keys, F.col("__dev_now").alias("deviance"), (F.col("__nobs") - rank).alias("df_residual"), F.col("__nobs").alias("n_obs"),
                        rank.alias("rank"), (~F.col("__going")).alias("converged"), F.col("__steps").alias("iterations"),
                        (F.col("__dev_now") + 2.0 * rank).alias("aic"))
    solved = state.mapInArrow(errors, key_ddl + "__beta array<double>, __keep array<boolean>, __se array<double>")
    return _tidy(solved, keys, terms), fits


def _tidy(solved: DataFrame, keys: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """(keys, __beta[], __keep[], __se[]) -> one row per kept term."""
    cells = F.arrays_zip(F.array(*map(F.lit, terms)).alias("term"), F.col("__beta").alias("b"), F.col("__se").alias("s"), F.col("__keep").alias("k"))
    t = solved.select(*keys, F.explode(cells).alias("__t")).filter("__t.k")
    t = t.select(*keys, F.col("__t.term").alias("term"), F.col("__t.b").alias("estimate"), F.col("__t.s").alias("std_error"))
    return t.withColumn("statistic", F.try_divide("estimate", "std_error")).withColumn("p_value", dist.norm_two_sided_p(F.col("statistic")))


def logit_responses(df: DataFrame, responses: Sequence[str], xs: Sequence[str], name: str = "response", **kw) -> tuple[DataFrame, DataFrame]:
    """K7: one logistic model per 0/1 response column, all on the same covariates.

    Rows are compressed once to (x...) -> n and one sum per response; patterns, not rows, are then repeated per
    response. A row with a missing covariate or response is left out of all models."""
    complete = complete_cases(df, [*responses, *xs])
    table = complete.groupBy(*[F.col(x).cast("double").alias(x) for x in xs]).agg(
        F.count(F.lit(1)).cast("double").alias("__n"), *[F.sum(F.col(r).cast("double")).alias(f"__y_{i}") for i, r in enumerate(responses)])
    each = F.explode(F.array(*[F.struct(F.lit(r).alias(name), F.col(f"__y_{i}").alias("__y")) for i, r in enumerate(responses)]))
    patterns = table.withColumn("__r", each).select("__r.*", *xs, "__n")
    return logit_grouped(patterns, [name], "__y", xs, compressed=True, **kw)


def _key_types(df: DataFrame, keys: Sequence[str]) -> list[tuple[str, str]]:
    d = dict(df.dtypes)
    return [(k, d[k]) for k in keys]


def logit(df: DataFrame, y: str, xs: Sequence[str], weight: str | None = None, **kw):
    """A single logistic model (``xs=[]`` is the null model)."""
    return logit_grouped(df, [], y, xs, weight, **kw)


# ---------------------------------------------------------------- K8 model grid

def model_grid(df: DataFrame, outcomes: Mapping[str, tuple[str, Column | str | None]],
               formulas: Mapping[str, Sequence[str]], y_name: str = "__y_val") -> tuple[DataFrame, list[str]]:
    """K8: outcome x formula grid in one frame (one scan, ``explode``), for :func:`logit_grouped`.

    ``outcomes``: name -> (y column, inclusion predicate or None). ``formulas``: name -> term list.
    Returns the long frame with keys ``outcome, model`` and the union of terms (terms not in a model
    are zero there, so the alias sweep drops them), plus that term order.
    """
    terms = []
    for ts in formulas.values():
        for t in ts:
            if t not in terms:
                terms.append(t)
    passed = [F.when(F.lit(True) if pred is None else (pred if isinstance(pred, Column) else F.expr(pred)),
                     F.lit(name)) for name, (_y, pred) in outcomes.items()]
    out = df.withColumn("outcome", F.explode(F.array_compact(F.array(*passed))))
    out = out.withColumn("model", F.explode(F.array(*[F.lit(m) for m in formulas])))
    ycase = None
    for name, (ycol, _p) in outcomes.items():
        ycase = F.when(F.col("outcome") == name, F.col(ycol).cast("double")) if ycase is None else \
            ycase.when(F.col("outcome") == name, F.col(ycol).cast("double"))
    out = out.withColumn(y_name, ycase)
    for t in terms:
        in_models = [m for m, ts in formulas.items() if t in ts]
        out = out.withColumn(t, F.when(F.col("model").isin(in_models), F.col(t).cast("double")).otherwise(0.0))
    return out.select("outcome", "model", y_name, *terms), terms


# ---------------------------------------------------------------- K11-K14

def deviance_table(fits: DataFrame, pairs: Mapping[str, tuple[str, str]], keys: Sequence[str] = ("outcome",),
                   model_col: str = "model") -> DataFrame:
    """Analysis of deviance for nested pairs ``{name: (smaller, larger)}``: two rows per pair,
    the first (smaller model) with NULL df/deviance/p, as R's ``anova(test='Chisq')``."""
    keys = list(keys)
    rows = [(name, small, large) for name, (small, large) in pairs.items()]
    cfg = fits.sparkSession.createDataFrame(rows, f"comparison string, __small string, __large string")
    s = fits.select(*keys, F.col(model_col).alias("__small"), F.col("df_residual").alias("s_df"),
                    F.col("deviance").alias("s_dev"))
    lg = fits.select(*keys, F.col(model_col).alias("__large"), F.col("df_residual").alias("l_df"),
                     F.col("deviance").alias("l_dev"))
    j = F.broadcast(cfg).join(s, "__small").join(lg, keys + ["__large"])
    first = j.select(*keys, "comparison", F.lit(1).alias("row"), F.col("s_df").alias("resid_df"),
                     F.col("s_dev").alias("resid_dev"), F.lit(None).cast("double").alias("df"),
                     F.lit(None).cast("double").alias("deviance"), F.lit(None).cast("double").alias("p_value"))
    ddf = F.col("s_df") - F.col("l_df")
    ddev = F.col("s_dev") - F.col("l_dev")
    second = j.select(*keys, "comparison", F.lit(2).alias("row"), F.col("l_df").alias("resid_df"),
                      F.col("l_dev").alias("resid_dev"), ddf.alias("df"), ddev.alias("deviance"),
                      dist.chi2_sf(ddev, ddf.cast("int")).alias("p_value"))
    return first.unionByName(second)


def odds_ratio(coefs: DataFrame, z: float = 1.96) -> DataFrame:
    """exp(estimate) with exp(estimate +- z * SE)."""
    return coefs.withColumn("odds_ratio", F.exp("estimate")) \
        .withColumn("conf_low", F.exp(F.col("estimate") - z * F.col("std_error"))) \
        .withColumn("conf_high", F.exp(F.col("estimate") + z * F.col("std_error")))


def coef_table(tables: Mapping[str, DataFrame], label: str = "comparison") -> DataFrame:
    """Stack coefficient frames with a label column."""
    out = None
    for name, t in tables.items():
        t = t.withColumn(label, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def coef_table(tables: Mapping[str, DataFrame], label: str = "comparison") -> DataFrame:
    """Coefficient frames of several fits stacked under a label; columns that one lacks are NULL."""
    frames = [t.withColumn(label, F.lit(name)) for name, t in tables.items()]
    out = frames[0]
    for t in frames[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def compare_coefs(full: DataFrame, nested: DataFrame, keys: Sequence[str] = ("outcome",)) -> DataFrame:
    """Full vs nested estimate and p per term, side by side."""
    keys = list(keys)
    a = full.select(*keys, "term", F.col("estimate").alias("estimate_full"), F.col("p_value").alias("p_full"))
    b = nested.select(*keys, "term", F.col("estimate").alias("estimate_nested"), F.col("p_value").alias("p_nested"))
    return a.join(b, keys + ["term"], "full")


# ---------------------------------------------------------------- K19 OLS

def ols_grouped(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], weight: str | None = None
                ) -> tuple[DataFrame, DataFrame]:
    """Linear model per key by normal equations from ONE aggregate (X'WX, X'Wy, y'Wy, n).

    Returns coefficients (keys, term, estimate, std_error, statistic, p_value [normal approx]) and fits
    (keys, rss, df_residual, n_obs, rank, sigma, xbar_<x> = weighted covariate means from the same pass).
    """
    from ..session import run_by_value, saved
    keys, xs = list(keys), list(xs)
    p = len(xs) + 1
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    yv = F.col(y).cast("double")
    df = complete_cases(df, [y, *xs, *([weight] if weight else [])])
    agg = df.groupBy(*keys).agg(*_gram_aggs(xs, w, w * yv), F.sum(w * yv * yv).alias("__yy"), F.sum(w).alias("__n"))
    run_by_value(__name__)

    def solve(batches):
        for batch in batches:
            gram, rhs = _grams(batch, p), np.stack([_doubles(batch, f"__r_{i}") for i in range(p)], axis=1)
            keep = alias_masks(gram)
            beta = masked_solve(gram, rhs, keep)
            rss = _doubles(batch, "__yy") - 2 * (beta * rhs).sum(axis=1) + np.einsum("ki,kij,kj->k", beta, gram, beta)
            n, rank = _doubles(batch, "__n"), keep.sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                sigma = np.sqrt(np.maximum(rss, 0.0) / (n - rank))
                xbar = gram[:, 0, 1:] / gram[:, :1, 0]
            has = n > rank
            se = masked_se(gram, keep) * np.where(has, sigma, np.nan)[:, None]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), _lists(beta), _lists(keep), _lists(se), pa.array(rss), pa.array(n - rank), pa.array(n),
                 pa.array(rank.astype(np.int32)), pa.array(sigma, mask=~has), *(pa.array(xbar[:, i], mask=~(n > 0)) for i in range(p - 1))],
                names=[*keys, "__beta", "__keep", "__se", "rss", "df_residual", "n_obs", "rank", "sigma", *[f"xbar_{x}" for x in xs]])

    ddl = "".join(f"`{n}` {t}, " for n, t in _key_types(df, keys)) + "__beta array<double>, __keep array<boolean>, __se array<double>, rss double, " \
        "df_residual double, n_obs double, rank int, sigma double" + "".join(f", `xbar_{x}` double" for x in xs)
    solved = saved(agg.mapInArrow(solve, ddl), "ols")
    return _tidy(solved, keys, [INTERCEPT] + xs), solved.drop("__beta", "__keep", "__se")


def predict_linear(df: DataFrame, coefs: DataFrame, xs: Sequence[str], keys: Sequence[str] = (),
                   out: str = "pred", link: str = "identity") -> DataFrame:
    """Linear predictor from a long coefficient frame (wide-joined per key, checked broadcast)."""
    keys = list(keys)
    wide = coefs.groupBy(*keys).agg(*[F.max(F.when(F.col("term") == t, F.col("estimate"))).alias(f"__c_{i}")
                                      for i, t in enumerate([INTERCEPT] + list(xs))])
    j = df.join(checked_broadcast(wide), keys) if keys else df.crossJoin(F.broadcast(wide))
    eta = F.coalesce(F.col("__c_0"), F.lit(0.0))
    for i, x in enumerate(xs, start=1):
        eta = eta + F.coalesce(F.col(f"__c_{i}"), F.lit(0.0)) * F.col(x).cast("double")
    val = eta if link == "identity" else 1.0 / (1.0 + F.exp(-eta))
    return j.withColumn(out, val).drop(*[f"__c_{i}" for i in range(len(xs) + 1)])
