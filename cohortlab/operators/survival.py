"""Fine-Gray competing-risk regression and cumulative-incidence prediction.

Status coding: 0 = censored, 1 = event of interest, >= 2 = competing event.

Estimating equations (Fine & Gray 1999, Breslow ties): at an event time t the risk set holds every
subject with T >= t (weight 1) plus every competing-event subject with T < t, weighted G(t-)/G(T-),
where G is the Kaplan-Meier estimate of the censoring distribution. Hence each risk-set sum is

    S_k(t) = sum_{T_j >= t} r_j x_j^k  +  G(t-) * sum_{competing, T_j < t} r_j x_j^k / G(T_j-),   r = n e^{x b}

i.e. one descending and one ascending running sum along the time axis of a unit - no pairwise join.

Layout. Rows are compressed to patterns (unit, time, status, x) -> w[], a vector over bootstrap iterations (length 1
without a bootstrap). Patterns are laid out once: range partitions cut at sampled quantiles of (unit, time), packed
into chunks in the shared folder. A Newton step is two passes over the chunks: every chunk sums its rows, the sums are
scanned per unit (one small row per chunk), and every chunk adds its offset and returns the score and information of
its own events. Rows of one time may lie in several chunks; the scan carries sums of ties. The p x p solves happen
where the sums arrive; coefficients stay a DataFrame between steps, and the driver sees one number, how many fits are
still going. ``cells`` are covariate masks fitted on the same patterns (a formula grid without copies of the rows).
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_saved, run_by_value, saved, saved_counting
from . import vectors
from .agg import running_sums
from .glm import alias_masks, complete_cases, masked_se, masked_solve
from .vectors import chunked, lists, matrix, offsets, running, summed

_LOG_ZERO = -745.0


def _pairs(p):
    return [(a, b) for a in range(p) for b in range(a, p)]


def _ddl(df: DataFrame, cols: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{c}` {types[c]}, " for c in cols)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


# ---- censoring distribution -----------------------------------------------------------------------------------------

def censoring_km(pats: DataFrame, unit: Sequence[str], rows: int | None = None) -> DataFrame:
    """Kaplan-Meier of the censoring distribution, per iteration: (unit..., time, g[]) with g = G(time-)."""
    unit = list(unit)
    run_by_value(__name__, vectors.__name__)

    def at_risk(batches):
        for batch in batches:
            if batch.num_rows:
                w = matrix(batch.column("w"))
                c = w * (batch.column("status").to_numpy() == 0)[:, None]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in unit), batch.column("time"), lists(np.concatenate([w, c], axis=1))],
                                                 names=[*unit, "time", "v"])

    def log_factor(batches):
        for batch in batches:
            if batch.num_rows:
                v, risk = matrix(batch.column("v")), matrix(batch.column("risk"))
                b = v.shape[1] // 2
                with np.errstate(divide="ignore", invalid="ignore"):
                    frac = np.where(risk[:, :b] > 0, 1.0 - v[:, b:] / risk[:, :b], 1.0)
                    lg = np.where(frac > 0, np.log(np.maximum(frac, 1e-300)), _LOG_ZERO)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in unit), batch.column("time"), lists(lg)], names=[*unit, "time", "lg"])

    def exponential(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in unit), batch.column("time"), lists(np.exp(matrix(batch.column("cum"))))],
                                                 names=[*unit, "time", "g"])

    key = _ddl(pats, unit) + "time double, "
    times = summed(pats.mapInArrow(at_risk, key + "v array<double>"), [*unit, "time"])
    risk = running(times, unit, "time", "v", "risk", descending=True, rows=rows)
    cum = running(risk.mapInArrow(log_factor, key + "lg array<double>"), unit, "time", "lg", "cum", inclusive=False, rows=rows)
    return cum.mapInArrow(exponential, key + "g array<double>")


def layout(pats: DataFrame, unit: Sequence[str], xs: Sequence[str], rows: int | None = None) -> DataFrame:
    """Patterns (unit, time, status, xs, w[]) as chunks with g[] next to events and competing events, written once."""
    g = censoring_km(pats, unit, rows)
    # censored rows need no G: their (often most frequent) times stay out of the join
    events = pats.filter("status >= 1").join(g, [*unit, "time"], "left")
    whole = events.unionByName(pats.filter("status < 1").withColumn("g", F.lit(None).cast("array<double>")))
    return saved(chunked(whole.select(*unit, "time", "status", *xs, "w", "g"), unit, "time", rows), "survival-chunks")


def _met(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join spread over all shuffle partitions: chunks are few and small but costly, and would be coalesced to one task."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n, *on).join(right.repartition(n, *on), list(on))


# ---- one chunk ------------------------------------------------------------------------------------------------------

class _Chunk:
    """Arrays of one chunk row: x (m, p), w and g (m, b), times and status."""

    def __init__(self, row: pa.RecordBatch, xs: Sequence[str]):
        self.time = row.column("time")[0].values.to_numpy(zero_copy_only=False)
        self.status = row.column("status")[0].values.to_numpy(zero_copy_only=False)
        self.x = np.stack([row.column(c)[0].values.to_numpy(zero_copy_only=False) for c in xs], axis=1) if xs else np.zeros((len(self.time), 0))
        self.w = matrix(row.column("w")[0].values)
        self.g = np.ones_like(self.w)
        g = row.column("g")[0].values
        has = g.is_valid().to_numpy(zero_copy_only=False)
        if has.any():
            self.g[has] = matrix(g.filter(pa.array(has)))

    def weights(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """r = w e^{x b} of all rows, and r / G(T-) of competing ones (else 0)."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            r = np.where(self.w > 0, self.w * np.exp(self.x @ beta), 0.0)
            c = np.where((self.status >= 2)[:, None] & (self.g > 0), r / self.g, 0.0)
        return r, c

    def terms(self) -> Iterator[np.ndarray]:
        p = self.x.shape[1]
        yield np.ones(len(self.time))
        for i in range(p):
            yield self.x[:, i]
        for a, b in _pairs(p):
            yield self.x[:, a] * self.x[:, b]


def _chunk_sums(k: _Chunk, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per cell, for A and C, per term and iteration: sums over the chunk and over the rows at its last time."""
    tied = k.time == k.time[-1]
    total, tie = [], []
    for cell in beta:
        for v in k.weights(cell):
            t = np.stack(list(k.terms()))
            total.append(t @ v)
            tie.append(t[:, tied] @ v[tied])
    return np.concatenate([x.ravel() for x in total]), np.concatenate([x.ravel() for x in tie])


def _chunk_events(k: _Chunk, beta: np.ndarray, before: np.ndarray, after: np.ndarray, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over the chunk's events: per cell [loglik, bad, lambda, events, score, information], each per iteration.

    Also the jump d/S0 of each event row per cell (and which rows those are)."""
    cells, p, b = beta.shape
    n_terms = 1 + p + p * (p + 1) // 2
    shape = (cells, 2, n_terms, b)
    before, after, tied = (x.reshape(shape) for x in (before, after, tied))
    ev = np.flatnonzero(k.status == 1)
    first = np.searchsorted(k.time, k.time[ev])             # first row with the event's time
    at_start = (k.time[ev] == k.time[0])[:, None]
    w, x = k.w[ev], k.x[ev]
    live = w > 0
    out, jumps = [], []
    for c in range(cells):
        r, comp = k.weights(beta[c])
        s = []
        for t, v in enumerate(k.terms()):
            a = np.cumsum((r * v[:, None])[::-1], axis=0)[::-1][first] + after[c, 0, t] + at_start * tied[c, 0, t]
            cum = np.cumsum(np.concatenate([np.zeros((1, b)), comp * v[:, None]]), axis=0)[first] + before[c, 1, t] - at_start * tied[c, 1, t]
            s.append(a + k.g[ev] * cum)
        s0 = s[0]
        ok = live & (s0 > 0) & np.isfinite(s0)
        inv = np.where(ok, 1.0 / np.where(ok, s0, 1.0), 0.0)
        lam = w * inv
        with np.errstate(invalid="ignore"):
            rows = [(w * (x @ beta[c])).sum(axis=0) - np.where(ok, w * np.log(np.where(ok, s0, 1.0)), 0.0).sum(axis=0),
                    (live & ~ok).sum(axis=0), lam.sum(axis=0), w.sum(axis=0)]
            m = [s[1 + i] * inv for i in range(p)]
            rows += [(w * (x[:, i:i + 1] - m[i])).sum(axis=0) for i in range(p)]
            rows += [(w * (s[1 + p + j] * inv - m[a2] * m[b2])).sum(axis=0) for j, (a2, b2) in enumerate(_pairs(p))]
        out.append(np.stack(rows))
        jumps.append(lam)
    return np.stack(out).ravel(), np.stack(jumps) if jumps else np.zeros((0, 0, b)), ev


def _unpacked(v: np.ndarray, cells: int, p: int, b: int):
    """loglik, bad, lambda, events (cells, b), score (cells, b, p), information (cells, b, p, p)."""
    t = v.reshape(cells, 4 + p + p * (p + 1) // 2, b)
    info = np.zeros((cells, b, p, p))
    for j, (a2, b2) in enumerate(_pairs(p)):
        info[:, :, a2, b2] = info[:, :, b2, a2] = t[:, 4 + p + j]
    return t[:, 0], t[:, 1], t[:, 2], t[:, 3], np.moveaxis(t[:, 4:4 + p], 1, 2), info


# ---- Newton steps ---------------------------------------------------------------------------------------------------

STATE = "beta array<double>, se array<double>, keep array<boolean>, going array<boolean>, failed array<boolean>, steps array<int>, " \
        "loglik array<double>, lam array<double>, events array<double>"


def fit_cells(chunks: DataFrame, unit: Sequence[str], xs: Sequence[str], cells: Sequence[Sequence[bool]], b: int,
              max_iter: int = 10, gtol: float = 1e-6, tol: float = 1e-9) -> DataFrame:
    """One row per unit of :func:`layout` chunks with the state of its cells x iterations fits (STATE, flat arrays
    in the order cell, covariate, iteration). ``lam`` is the baseline cumulative hazard at the last event time."""
    unit, xs = list(unit), list(xs)
    p, n_cells = len(xs), len(cells)
    mask = np.array(cells, bool).reshape(n_cells, p)
    key = _ddl(chunks, unit)
    run_by_value(__name__, vectors.__name__, alias_masks.__module__)

    def beta_of(row: pa.RecordBatch) -> np.ndarray:
        return row.column("beta")[0].values.to_numpy(zero_copy_only=False).reshape(n_cells, p, b)

    def totals(batches):
        for row in _rows(batches):
            k = _Chunk(row, xs)
            total, tie = _chunk_sums(k, beta_of(row))
            yield pa.RecordBatch.from_arrays([*(row.column(c) for c in unit), row.column("chunk"), pa.array([k.time[0]]), pa.array([k.time[-1]]),
                                              lists(total[None]), lists(tie[None])], names=[*unit, "chunk", "first", "last", "total", "tie"])

    def events(batches):
        for row in _rows(batches):
            v, _, _ = _chunk_events(_Chunk(row, xs), beta_of(row), *(row.column(c)[0].values.to_numpy() for c in ("before", "after", "tied")))
            yield pa.RecordBatch.from_arrays([*(row.column(c) for c in unit), lists(v[None])], names=[*unit, "v"])

    def solved(last: bool):
        def run(batches):
            for row in _rows(batches):
                get = lambda c: row.column(c)[0].values.to_numpy(zero_copy_only=False).copy()
                beta = np.moveaxis(beta_of(row), 1, 2).copy()                               # (cells, b, p)
                keep = get("keep").astype(bool).reshape(n_cells, b, p)
                going, failed = (get(c).astype(bool).reshape(n_cells, b) for c in ("going", "failed"))
                steps = get("steps").reshape(n_cells, b)
                loglik, bad, lam, n_events, score, info = _unpacked(row.column("v")[0].values.to_numpy(zero_copy_only=False), n_cells, p, b)
                fine = (bad == 0) & np.isfinite(info).all(axis=(2, 3)) & np.isfinite(score).all(axis=2) & (n_events > 0)
                failed |= going & ~fine         # no event, or a numerically degenerate (separated) resample
                going &= fine
                if not steps.any():             # first step, at beta = 0: columns without variation or collinear ones are left out
                    part = mask[:, None, :, None] & mask[:, None, None, :] & going[..., None, None]
                    keep = alias_masks(np.where(part, info, 0.0).reshape(n_cells * b, p, p)).reshape(keep.shape)
                used = keep & fine[..., None]
                system, used_flat = np.where(fine[..., None, None], info, 0.0).reshape(n_cells * b, p, p), used.reshape(n_cells * b, p)
                if last:
                    se = masked_se(system, used_flat).reshape(used.shape)
                    failed |= ~fine
                else:
                    se = np.moveaxis(get("se").reshape(n_cells, p, b), 1, 2)
                    grad = np.where(used, score, 0.0)
                    step = masked_solve(system, grad.reshape(n_cells * b, p), used_flat).reshape(used.shape)
                    beta += step * going[..., None]
                    steps += going
                    done = ((grad * step).sum(axis=2) < gtol) | (np.abs(step).max(axis=2, initial=0.0) < tol)
                    going &= ~done              # score criterion met; the last (tiny) step is kept
                flat = lambda m: np.moveaxis(m, 2, 1).ravel()
                cols = [lists(flat(beta)[None]), lists(flat(se)[None])]
                cols += [pa.array([m.ravel().tolist()], pa.list_(t)) for m, t in ((keep, pa.bool_()), (going, pa.bool_()), (failed, pa.bool_()), (steps, pa.int32()))]
                cols += [lists(m.ravel()[None]) for m in (loglik, lam, n_events)]
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in unit), *cols], names=[*unit, *[f.split()[0] for f in STATE.split(", ")]])
        return run

    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    n_fits = n_cells * b
    state = saved(chunks.select(*unit).distinct().select(
        *unit, zeros(n_fits * p).alias("beta"), zeros(n_fits * p).alias("se"), F.array_repeat(F.lit(False), n_fits * p).alias("keep"),
        F.array_repeat(F.lit(True), n_fits).alias("going"), F.array_repeat(F.lit(False), n_fits).alias("failed"),
        F.array_repeat(F.lit(0), n_fits).alias("steps"), *[zeros(n_fits).alias(c) for c in ("loglik", "lam", "events")]), "survival-state")

    def pass_over(state: DataFrame, last: bool) -> DataFrame:
        at = chunks.join(state.select(*unit, "beta"), unit)
        sums = at.mapInArrow(totals, key + "chunk long, first double, last double, total array<double>, tie array<double>")
        found = _met(at, offsets(sums, unit), [*unit, "chunk"]).mapInArrow(events, key + "v array<double>")
        return saved_counting(state.join(summed(found, unit), unit).mapInArrow(solved(last), key + STATE), "survival-state",
                              going=F.count_if(F.exists("going", lambda g: g)))

    for _ in range(max_iter):
        new, seen = pass_over(state, False)
        drop_saved(state)
        state = new
        if not seen["going"]:
            break
    new, _ = pass_over(state, True)
    drop_saved(state)
    return new


# ---- K20 ------------------------------------------------------------------------------------------------------------

def columns(xs: Sequence[str]) -> list[str]:
    """Names of the covariates inside the engine, so that they cannot clash with its own columns."""
    return [f"__x{i}" for i in range(len(xs))]


def _compress(df: DataFrame, keys, time, status, xs, weight):
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(*keys, F.col(time).cast("double").alias("time"), F.col(status).cast("int").alias("status"),
                      *[F.col(x).cast("double").alias(c) for x, c in zip(xs, columns(xs))]).agg(F.sum(w).alias("n"))


def fine_gray(df: DataFrame, keys: Sequence[str], time: str, status: str, xs: Sequence[str],
              weight: str | None = None, max_iter: int = 10, gtol: float = 1e-6, tol: float = 1e-9,
              rows_per_bucket: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fine-Gray subdistribution hazard regression per key.

    ``rows_per_bucket``: rows of one chunk of the time axis. A key's axis is always cut into range partitions and
    chunks; no task sorts or holds all of it.

    Newton-Raphson from beta = 0; a key stops when u' I^-1 u < ``gtol`` (score-based, as the usual
    competing-risk solver does) or the step is below ``tol``; at most ``max_iter`` (default 10) steps.

    Returns (coefficients[keys, term, estimate, std_error, statistic, p_value],
             baseline[keys, time, cum_hazard], fits[keys, loglik, iterations, converged, n_events]); a key without
    events of interest has a row in fits (converged false, n_events 0), no baseline and no coefficients.
    """
    from ..functions import dist
    keys, xs = list(keys), list(xs)
    unit = [*keys, "blk"]
    p = len(xs)
    df = complete_cases(df, [time, status, *xs, *([weight] if weight else [])])
    pats = _compress(df, keys, time, status, xs, weight).select(*keys, F.lit(0).alias("blk"), "time", "status", *columns(xs), F.array("n").alias("w"))
    chunks = layout(saved(pats, "survival-patterns"), unit, columns(xs), rows_per_bucket)
    fit = fit_cells(chunks, unit, columns(xs), [[True] * p], 1, max_iter, gtol, tol)
    at = lambda c, i=0: F.element_at(c, i + 1)
    terms = F.explode(F.filter(F.array(*[F.struct(F.lit(x).alias("term"), at("beta", i).alias("estimate"), at("se", i).alias("std_error"), at("keep", i).alias("kept"))
                                         for i, x in enumerate(xs)]), lambda t: t["kept"])) if p else None
    none = fit.limit(0).select(*keys, F.lit("").alias("term"), F.lit(0.0).alias("estimate"), F.lit(0.0).alias("std_error"))
    coefs = fit.select(*keys, terms.alias("t")).select(*keys, "t.term", "t.estimate", "t.std_error") if p else none
    coefs = coefs.withColumn("statistic", F.col("estimate") / F.col("std_error")).withColumn("p_value", dist.norm_two_sided_p(F.col("statistic")))
    fits = fit.select(*keys, F.when(at("events") > 0, at("loglik")).alias("loglik"), at("steps").alias("iterations"),
                      (~at("going") & ~at("failed")).alias("converged"), at("events").alias("n_events"))
    return coefs, _baseline(chunks, fit, keys, unit, columns(xs), rows_per_bucket), fits


def _baseline(chunks: DataFrame, fit: DataFrame, keys, unit, xs, rows) -> DataFrame:
    """(keys, time, cum_hazard) at the final coefficients: jumps per event time, then a prefix scan along the times."""
    p = len(xs)

    def beta_of(row):
        return row.column("beta")[0].values.to_numpy(zero_copy_only=False).reshape(1, p, 1)

    def totals(batches):
        for row in _rows(batches):
            k = _Chunk(row, xs)
            total, tie = _chunk_sums(k, beta_of(row))
            yield pa.RecordBatch.from_arrays([*(row.column(c) for c in unit), row.column("chunk"), pa.array([k.time[0]]), pa.array([k.time[-1]]),
                                              lists(total[None]), lists(tie[None])], names=[*unit, "chunk", "first", "last", "total", "tie"])

    def jumps(batches):
        for row in _rows(batches):
            k = _Chunk(row, xs)
            _, lam, ev = _chunk_events(k, beta_of(row), *(row.column(c)[0].values.to_numpy() for c in ("before", "after", "tied")))
            again = pa.array(np.zeros(len(ev), np.int64))
            yield pa.RecordBatch.from_arrays([*(row.column(c).take(again) for c in unit), pa.array(k.time[ev]), lists(lam[0].reshape(len(ev), 1))],
                                             names=[*unit, "time", "v"])

    key = _ddl(chunks, unit)
    at = chunks.join(fit.select(*unit, "beta"), unit)
    sums = at.mapInArrow(totals, key + "chunk long, first double, last double, total array<double>, tie array<double>")
    found = _met(at, offsets(sums, unit), [*unit, "chunk"]).mapInArrow(jumps, key + "time double, v array<double>")
    steps = running(summed(found, [*unit, "time"]), unit, "time", "v", "cum", rows=rows)
    return saved(steps.select(*keys, "time", F.element_at("cum", 1).alias("cum_hazard")), "survival-baseline")


# ---- K21 ------------------------------------------------------------------------------------------------------------

def predict_cif_last(df: DataFrame, coefs: DataFrame, baseline: DataFrame, xs: Sequence[str],
                     keys: Sequence[str] = (), out: str = "pred") -> DataFrame:
    """Cumulative incidence at the last event time: 1 - exp(-Lambda(t_max) * exp(x b)) per row.

    Every row is kept; a key without events of interest has risk 0."""
    return predict_cif(df, coefs, baseline, xs, keys, None, out)


def predict_cif(df: DataFrame, coefs: DataFrame, baseline: DataFrame, xs: Sequence[str], keys: Sequence[str] = (),
                at: float | str | None = None, out: str = "pred") -> DataFrame:
    """Cumulative incidence at a time: the last event time (None), a number, or a column of ``df``.

    The baseline is a step function: the value at ``at`` is that of the last step not after it, 0 before the first.
    Rows of keys without a baseline (no event) get 0; no row is lost. For a column the steps and the rows are put on
    one axis and the jumps are summed along it (range partitions, see :func:`agg.running_sums`)."""
    keys, cols = list(keys), df.columns
    wide = coefs.groupBy(*keys).agg(*[F.max(F.when(F.col("term") == x, F.col("estimate"))).alias(f"__c{i}") for i, x in enumerate(xs)],
                                    F.lit(1).alias("__one"))
    j = df.join(wide, keys, "left") if keys else df.crossJoin(F.broadcast(wide))
    if isinstance(at, str):
        # steps and the rows' times are points of one axis; the cumulative hazard never falls, so the last step is the maximum so far
        rows = saved(j, "cif-rows")
        first = [*keys, "__t"]
        before = baseline.select(*keys, F.col("time").alias("__t"), F.col("cum_hazard").alias("__h"))
        points = rows.select(*keys, F.col(at).cast("double").alias("__t")).filter("__t is not null").distinct()
        axis = points.join(before, first, "full").groupBy(*first).agg(F.max("__h").alias("__h"))
        lam = running_sums(axis, keys, "__t", ["__h"], bucketed=True, how="max", prefix="__lam").select(*first, F.col("__lam__h").alias("__lam"))
        j = rows.withColumn("__t", F.col(at).cast("double")).join(lam, first, "left").drop("__t")
    else:
        steps = baseline if at is None else baseline.filter(F.col("time") <= F.lit(float(at)))
        lam = steps.groupBy(*keys).agg(F.max("cum_hazard").alias("__lam"))
        j = j.join(lam, keys, "left") if keys else j.crossJoin(F.broadcast(lam))
    xb = F.lit(0.0)
    for i, x in enumerate(xs):
        xb = xb + F.coalesce(F.col(f"__c{i}"), F.lit(0.0)) * F.col(x).cast("double")
    return j.withColumn(out, 1.0 - F.exp(-F.coalesce(F.col("__lam"), F.lit(0.0)) * F.exp(xb))).select(*cols, out)
