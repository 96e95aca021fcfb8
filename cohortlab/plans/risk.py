"""Bootstrapped standardised-risk grid.

exposure (e.g. ABO, Rh) x adjustment (unadjusted, adjusted) x outcome (prevalence: linear probability
model; intubation / death: Fine-Gray) x (apparent + B bootstrap iterations).

Persons are compressed to covariate patterns with one vector of bootstrap multiplicities (``vectors``), once per
outcome; no row exists per person and iteration, nor per model. The cells of the grid are covariate masks over the same
patterns, and every sufficient statistic is a vector over iterations:

* linear model: X'WX and X'Wy per cell and iteration from one pass over the patterns, solved where the sums arrive;
  the standardised risk is ``b . xbar`` with the exposure columns overwritten;
* Fine-Gray: all cells and iterations of a block step together (``survival.fit_cells``); the standardised risk is the
  weighted mean over patterns of ``1 - exp(-Lambda(t_max) exp(x b))``.

Then RD / NNT / RR against the reference stratum per (cell, iteration) and percentile intervals over iterations, next
to the apparent estimate. A fit that fails (no events, a level of the exposure without persons, separated data,
not converged) gives NULL risks: ``n_boot_used`` and ``n_failed`` say how many iterations an interval rests on.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resample, survival, vectors
from ..operators.glm import alias_masks, masked_solve
from ..operators.relational import union_all
from ..operators.vectors import Blocks, lists, matrix, pattern_vectors, summed
from ..session import run_by_value, saved

ITER = "bootstrap_iteration"
RISKS = f"exposure string, model string, {ITER} int, stratum string, risk double"


class Grid:
    """The cells (exposure x adjustment) as masks over one list of covariates, and the strata of each exposure."""

    def __init__(self, exposures: Mapping[str, Sequence[str]], strata: Mapping[str, Mapping[str, Mapping[str, float]]],
                 adjustments: Mapping[str, Sequence[str]]):
        self.xs = list(dict.fromkeys(x for cols in [*exposures.values(), *adjustments.values()] for x in cols))
        self.names = survival.columns(self.xs)      # inside the engine
        self.cells = [(e, m) for e in exposures for m in adjustments]
        self.masks = [[x in exposures[e] or x in adjustments[m] for x in self.xs] for e, m in self.cells]
        self.strata = {e: [(s, [(self.xs.index(c), float(v)) for c, v in a.items()]) for s, a in strata[e].items()] for e in exposures}
        self.levels = {e: sorted({c for _, values in self.strata[e] for c, v in values if v}) for e in exposures}


def _risk_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64())
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t, from_pandas=True) for c, t in zip(cols, types)], names=[f.split()[0] for f in RISKS.split(", ")])


def linear_risks(df: DataFrame, y: str, person: str, grid: Grid, n_boot: int, seed: int = 0) -> DataFrame:
    """Standardised risks of a linear probability model per (exposure, model, iteration, stratum)."""
    xs, blocks = grid.names, Blocks(n_boot)
    p = len(xs) + 1
    cells, masks, strata, levels = grid.cells, [np.array(m, bool) for m in grid.masks], grid.strata, grid.levels
    src = df.select(person, F.col(y).alias("__y"), *[F.col(x).alias(c) for x, c in zip(grid.xs, xs)])
    pats = pattern_vectors(src, person, ["__y", *xs], n_boot, seed)
    run_by_value(__name__, vectors.__name__, alias_masks.__module__)

    def grams(batches):
        """One Gram matrix over all covariates, with y as the last column: cells are parts of it."""
        for batch in batches:
            if batch.num_rows:
                cols = [np.ones(batch.num_rows), *(batch.column(c).to_numpy(zero_copy_only=False) for c in [*xs, "__y"])]
                prod = np.stack([cols[i] * cols[j] for i in range(p + 1) for j in range(i, p + 1)], axis=1)
                w, blk = matrix(batch.column("w")), batch.column("blk").to_numpy()
                for k in np.unique(blk):
                    yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), lists((prod[blk == k].T @ w[blk == k]).reshape(1, -1))], names=["blk", "v"])

    def solve(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                its = blocks.iterations(batch.column("blk")[i].as_py())
                v = batch.column("v")[i].values.to_numpy().reshape(-1, blocks.size)
                full = np.zeros((blocks.size, p + 1, p + 1))
                for q, (a, b) in enumerate((a, b) for a in range(p + 1) for b in range(a, p + 1)):
                    full[:, a, b] = full[:, b, a] = v[q]
                rows = []
                xbar = np.where(full[:, :1, 0] > 0, full[:, 0, :p] / np.maximum(full[:, :1, 0], 1e-300), np.nan)
                for (exposure, model), mask in zip(cells, masks):
                    used = np.append(True, mask)
                    gram = np.where(used[:, None] & used[None, :], full[:, :p, :p], 0.0)
                    keep = alias_masks(gram)
                    beta = masked_solve(gram, full[:, :p, p], keep)
                    fit = keep[:, [0, *(c + 1 for c in levels[exposure])]].all(axis=1)      # else a level without persons
                    for s, values in strata[exposure]:
                        x = np.where(used, xbar, 0.0)
                        for c, value in values:
                            x[:, c + 1] = value
                        rows += [(exposure, model, it, s, float(r) if ok else None)
                                 for it, r, ok in zip(its.tolist(), (beta * x).sum(axis=1), fit) if it <= n_boot]
                yield _risk_batch(rows)

    total = summed(pats.mapInArrow(grams, "blk int, v array<double>"), ["blk"])
    return total.mapInArrow(solve, RISKS)


def fine_gray_risks(competing: Mapping[str, DataFrame], person: str, time: str, status: str, grid: Grid, n_boot: int,
                    seed: int = 0, rows_per_chunk: int | None = None) -> DataFrame:
    """Standardised cumulative incidence at the last event time per (outcome, exposure, model, iteration, stratum).

    All outcomes are units of one fit and take their Newton steps together."""
    xs, blocks, cells, strata = grid.names, Blocks(n_boot), grid.cells, grid.strata
    b, p, n_cells, levels = blocks.size, len(xs), len(cells), grid.levels
    unit = ["outcome", "blk"]
    pats = union_all([pattern_vectors(df.select(person, F.col(time).alias("time"), F.col(status).alias("status"),
                                           *[F.col(x).alias(c) for x, c in zip(grid.xs, xs)]), person, ["time", "status", *xs], n_boot, seed)
                      .withColumn("outcome", F.lit(name)) for name, df in competing.items()])
    pats = saved(pats.withColumn("status", F.col("status").cast("int")), "risk-patterns")
    chunks = survival.layout(pats, unit, xs, rows_per_chunk)
    fit = survival.fit_cells(chunks, unit, xs, grid.masks, b)
    n_strata = sum(len(strata[e]) for e, _ in cells)
    run_by_value(__name__, vectors.__name__, survival.__name__)

    def predict(batches):
        """Per pattern batch: sum of w and, per cell and stratum, of w times the prediction."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                k = survival._Chunk(row, xs)
                beta = row.column("beta")[0].values.to_numpy().reshape(n_cells, p, b)
                lam = row.column("lam")[0].values.to_numpy().reshape(n_cells, b)
                out = [k.w.sum(axis=0)]
                for c, (exposure, _) in enumerate(cells):
                    for _, values in strata[exposure]:
                        x = k.x.copy()
                        for col, value in values:
                            x[:, col] = value
                        with np.errstate(over="ignore", invalid="ignore"):
                            out.append((k.w * -np.expm1(-lam[c] * np.exp(x @ beta[c]))).sum(axis=0))
                yield pa.RecordBatch.from_arrays([row.column("outcome"), row.column("blk"), lists(np.stack(out).reshape(1, -1))], names=[*unit, "v"])

    def rows_of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
                its = blocks.iterations(batch.column("blk")[i].as_py())
                v = get("v").reshape(1 + n_strata, b)
                bad = get("failed").astype(bool).reshape(n_cells, b) | get("going").astype(bool).reshape(n_cells, b)
                keep = get("keep").astype(bool).reshape(n_cells, b, p)
                rows, at = [], 0
                for c, (exposure, model) in enumerate(cells):
                    ok_fit = ~bad[c] & (v[0] > 0) & keep[c][:, levels[exposure]].all(axis=1)
                    for s, _ in strata[exposure]:
                        at += 1
                        for j, it in enumerate(its.tolist()):
                            if it <= n_boot:
                                ok = ok_fit[j]
                                rows.append((exposure, model, it, s, float(v[at, j] / v[0, j]) if ok else None))
                out = _risk_batch(rows)
                outcome = batch.column("outcome").take(pa.array(np.full(out.num_rows, i)))
                yield pa.RecordBatch.from_arrays([outcome, *out.columns], names=["outcome", *out.schema.names])

    total = summed(chunks.join(fit.select(*unit, "beta", "lam"), unit).mapInArrow(predict, "outcome string, blk int, v array<double>"), unit)
    return total.join(fit.select(*unit, "failed", "going", "keep"), unit).mapInArrow(rows_of, "outcome string, " + RISKS)


def summarise(risks: DataFrame, references: Mapping[str, str], keys: Sequence[str] = ("outcome", "exposure", "model")
              ) -> DataFrame:
    """K25 + K26: effects vs the reference stratum per iteration, apparent value + percentile interval."""
    keys = list(keys)
    e = resample.effects(risks, keys + [ITER], references, ref_group_col="exposure")
    cols = ["risk", "risk_difference", "nnt", "relative_risk"]
    out = resample.percentile_ci(e, keys + ["stratum"], cols)
    ref = F.create_map(*[v for k, s in references.items() for v in (F.lit(k), F.lit(s))])
    return out.withColumn("is_reference", F.col("stratum") == ref[F.col("exposure")])


def risk_grid(prevalence: DataFrame, competing: Mapping[str, DataFrame], person: str,
              exposures: Mapping[str, Sequence[str]], strata: Mapping[str, Mapping[str, Mapping[str, float]]],
              references: Mapping[str, str], adjustments: Mapping[str, Sequence[str]], n_boot: int = 1000,
              seed: int = 0, prevalence_y: str = "initial_cov_pos", time: str = "survival_time",
              status: str = "status") -> DataFrame:
    """The full grid -> one summary frame (outcome, exposure, model, stratum, estimates, CIs, fits used)."""
    grid = Grid(exposures, strata, adjustments)
    parts = [linear_risks(prevalence, prevalence_y, person, grid, n_boot, seed).withColumn("outcome", F.lit("prevalence")),
             fine_gray_risks(competing, person, time, status, grid, n_boot, seed)]
    # a few rows per cell and iteration; read several times by the effects
    return summarise(saved(union_all(parts), "risk-grid"), references)
