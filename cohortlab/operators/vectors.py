"""Statistics for many bootstrap iterations at once: one row per covariate pattern, one array over the iterations.

A person never becomes B rows. The multiplicities of a batch of persons are drawn as a matrix (persons x iterations)
from a counter-based hash of (seed, person, iteration), summed per covariate pattern, and only pattern vectors leave
the task. Iterations come in blocks (``blk``), so that one row stays small and blocks spread over tasks.

* :func:`pattern_vectors` - persons -> (pattern, blk, w[]);
* :func:`summed` - sums vectors per key: combined per Arrow batch, shuffled on the key, added up while streaming over
  the sorted partition. A hot key is one row per batch before the shuffle, and no task collects a key's rows;
* :func:`running` - running sums of vectors along an ordered axis as a distributed prefix scan: the axis is cut at
  sampled quantiles (range partitions) and into chunks; chunk totals are scanned, then every chunk adds its offset.

Draws are the Poisson bootstrap (multiplicity Poisson(1) by inverse CDF on 32 hash bits); iteration 0 is the apparent
sample (all 1). They depend on nothing but seed, person and iteration: a lost task draws the same again.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import run_by_value

BLOCK = 64                  # iterations in one vector
HELD_PATTERNS = 4096        # pattern vectors a task holds before it passes them on
ROWS_PER_CHUNK = 8192       # rows of one chunk of an axis

# The two multipliers of the 32-bit finaliser and the step between iterations
MIX_1, MIX_2, STEP = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B9
MASK = 0xFFFFFFFF

#: multiplicity k or more from these hash values on: P(Poisson(1) < k) in 2**-32
THRESHOLDS = [t for t in (math.floor(sum(math.exp(-1) / math.factorial(i) for i in range(k)) * 2 ** 32) for k in range(1, 14)) if t < 2 ** 32]


def fmix32(x: np.ndarray) -> np.ndarray:
    """32-bit finaliser (a bijection)."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(MIX_1)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(MIX_2)
    return x ^ (x >> np.uint32(16))


def multiplicities(persons: np.ndarray, iterations: np.ndarray, seed: int) -> np.ndarray:
    """(persons, iterations) draws; the two halves of the 64-bit person key enter on their own."""
    key = persons.astype(np.int64).view(np.uint64)
    low, high = (key & np.uint64(MASK)).astype(np.uint32), (key >> np.uint64(32)).astype(np.uint32)
    a = fmix32(low ^ np.uint32(seed * STEP & MASK))
    c = fmix32(a ^ high ^ np.uint32(MIX_1))
    b = (iterations.astype(np.uint64) * np.uint64(STEP) & np.uint64(MASK)).astype(np.uint32)
    u = fmix32(fmix32(a[:, None] + b[None, :]) ^ c[:, None])
    out = np.searchsorted(np.array(THRESHOLDS, np.uint32), u.ravel(), side="right").reshape(u.shape).astype(np.float64)
    out[:, iterations == 0] = 1.0
    return out


def sql_draw(person: str, iteration: str, seed: int = 0) -> str:
    """The same draw as an SQL expression for the oracle (32-bit integer steps on UBIGINT)."""
    def let(x: str, step: str) -> str:
        return f"list_transform({x}, lambda v: {step})"

    def mixed(x: str) -> str:
        x = let(x, f"(xor(v, v >> 16) * {MIX_1}::UBIGINT) & {MASK}::UBIGINT")
        x = let(x, f"(xor(v, v >> 13) * {MIX_2}::UBIGINT) & {MASK}::UBIGINT")
        return let(x, "xor(v, v >> 16)")

    a = mixed(f"[xor({person}::UBIGINT & {MASK}::UBIGINT, {seed * STEP & MASK}::UBIGINT)]")
    c = mixed(f"[xor(xor({a}[1], {person}::UBIGINT >> 32), {MIX_1}::UBIGINT)]")
    step = f"(({a}[1] + ({iteration}::UBIGINT * {STEP}::UBIGINT)) & {MASK}::UBIGINT)"
    u = mixed(f"[xor({mixed(f'[{step}]')}[1], {c}[1])]")
    hits = " + ".join(f"(v >= {t}::UBIGINT)::INT" for t in THRESHOLDS)
    return f"CASE WHEN {iteration} = 0 THEN 1 ELSE {let(u, hits)}[1] END"


# ---- Arrow <-> numpy ------------------------------------------------------------------------------------------------

def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of doubles as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def lists(m: np.ndarray) -> pa.Array:
    n, b = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * b), pa.array(np.ascontiguousarray(m, np.float64).ravel()))


def key_changes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """First rows of the runs of equal keys."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _run_sums(batch: pa.RecordBatch, keys: Sequence[str], vec: str) -> tuple[pa.RecordBatch, np.ndarray]:
    """Of a batch sorted by its keys: one row of keys and one summed vector per run."""
    first = key_changes(batch, keys)
    return batch.select(list(keys)).take(pa.array(first)), np.add.reduceat(matrix(batch.column(vec)), first, axis=0)


def summed(df: DataFrame, keys: Sequence[str], vec: str = "v") -> DataFrame:
    """Vectors summed per key. Keys must not be null (models are fitted on complete rows)."""
    keys = list(keys)
    run_by_value(__name__)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                head, sums = _run_sums(batch.sort_by([(k, "ascending") for k in keys]), keys, vec)
                yield pa.RecordBatch.from_arrays([*head.columns, lists(sums)], names=[*keys, vec])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None                    # the last key may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            head, sums = _run_sums(batch, keys, vec)
            if held is not None:
                if all(held.column(k)[0].as_py() == head.column(k)[0].as_py() for k in keys):
                    sums[0] += total
                else:
                    yield pa.RecordBatch.from_arrays([*held.columns, lists(total[None])], names=[*keys, vec])
            if len(sums) > 1:
                yield pa.RecordBatch.from_arrays([*head.slice(0, len(sums) - 1).columns, lists(sums[:-1])], names=[*keys, vec])
            held, total = head.slice(len(sums) - 1), sums[-1]
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns, lists(total[None])], names=[*keys, vec])

    out = df.select(*keys, vec)
    return out.mapInArrow(combine, out.schema).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, out.schema)


# ---- bootstrap ------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Blocks:
    """Iterations 0 to n_boot in equally long blocks; numbers beyond n_boot fill the last block and carry no weight."""
    n_boot: int

    @property
    def count(self) -> int:
        return -(-(self.n_boot + 1) // BLOCK)

    @property
    def size(self) -> int:
        return -(-(self.n_boot + 1) // self.count)

    def iterations(self, blk: int) -> np.ndarray:
        return np.arange(blk * self.size, (blk + 1) * self.size)


def pattern_vectors(df: DataFrame, person: str, cols: Sequence[str], n_boot: int, seed: int = 0) -> DataFrame:
    """(cols..., blk, w[]): summed multiplicities of the persons of each covariate pattern, all complete rows.

    ``cols`` are read as doubles. An integer ``person`` is the hash key itself, other types are hashed to 64 bits."""
    cols, blocks = list(cols), Blocks(n_boot)
    integral = dict(df.dtypes)[person] in ("tinyint", "smallint", "int", "bigint")
    key = F.col(person).cast("long") if integral else F.xxhash64(person)
    src = df.select(F.coalesce(key, F.lit(0)).alias("__person"), *[F.col(c).cast("double").alias(c) for c in cols]).dropna(how="any", subset=cols)
    src = src.filter(~F.greatest(F.lit(False), *[F.isnan(c) for c in cols])) if cols else src
    run_by_value(__name__)

    def passed_on(held: dict) -> Iterator[pa.RecordBatch]:
        if held:
            pats = np.array(list(held), np.float64).reshape(len(held), len(cols))
            w = np.stack(list(held.values()))
            for blk in range(blocks.count):
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(pats[:, j]) for j in range(len(cols))), pa.array(np.full(len(held), blk, np.int32)),
                     lists(w[:, blk * blocks.size:(blk + 1) * blocks.size])], names=[*cols, "blk", "w"])
            held.clear()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols], axis=1) + 0.0
                pats, code = np.unique(values, axis=0, return_inverse=True)
                code = code.ravel()
                order = np.argsort(code, kind="stable")
                first = np.searchsorted(code[order], np.arange(len(pats)))
                ids = batch.column("__person").to_numpy(zero_copy_only=False)[order]
                w = np.concatenate([np.add.reduceat(multiplicities(ids, blocks.iterations(blk), seed), first, axis=0)
                                    * (blocks.iterations(blk) <= n_boot) for blk in range(blocks.count)], axis=1)
                for row, vec in zip(map(tuple, pats.tolist()), w):
                    if row in held:
                        held[row] += vec
                    else:
                        held[row] = vec
                if len(held) >= HELD_PATTERNS:
                    yield from passed_on(held)
        yield from passed_on(held)

    ddl = "".join(f"`{c}` double, " for c in cols) + "blk int, w array<double>"
    return summed(src.mapInArrow(draw, ddl), [*cols, "blk"], "w")


def iteration_rows(df: DataFrame, n_boot: int, vec: str = "w", iter_col: str = "bootstrap_iteration", out: str = "boot_w") -> DataFrame:
    """Vectors as rows (one per pattern and iteration): for frames whose patterns are few."""
    size = Blocks(n_boot).size
    x = df.select(*[c for c in df.columns if c != vec], F.posexplode(vec).alias("__i", out))
    x = x.withColumn(iter_col, (F.col("blk") * size + F.col("__i")).cast("int")).drop("__i", "blk")
    return x.filter(F.col(iter_col) <= n_boot)


# ---- prefix scans along an axis -------------------------------------------------------------------------------------

def ranged(df: DataFrame, unit: Sequence[str], axis: str) -> DataFrame:
    """Rows cut into range partitions at sampled quantiles of (unit, axis), sorted within."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *unit, axis).sortWithinPartitions(*unit, axis)


def chunked(df: DataFrame, unit: Sequence[str], axis: str, rows: int | None = None) -> DataFrame:
    """Rows of :func:`ranged` order packed into chunks: (unit..., chunk, and one list per other column).

    A chunk holds at most ``rows`` rows of one unit; chunk numbers rise along the axis."""
    unit, rows = list(unit), rows or ROWS_PER_CHUNK
    rest = [c for c in df.columns if c not in unit]
    types = dict(df.dtypes)
    run_by_value(__name__)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 33, 0
        held: list[pa.RecordBatch] = []

        def out(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(pieces).combine_chunks()
            cols = [whole[c].chunk(0) for c in rest]
            packed = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols]
            return pa.RecordBatch.from_arrays([*(whole[c].chunk(0).slice(0, 1) for c in unit), pa.array([base + seq]), *packed], names=[*unit, "chunk", *rest])

        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = key_changes(batch, unit) if unit else np.zeros(1, np.int64)
            for lo, hi in zip(starts, np.append(starts[1:], batch.num_rows)):
                at = int(lo)
                if held and any(held[0].column(c)[0].as_py() != batch.column(c)[at].as_py() for c in unit):
                    yield out(held)
                    held, n, seq = [], 0, seq + 1
                while at < hi:
                    take = min(rows - n, int(hi) - at)
                    held.append(batch.slice(at, take))
                    n, at = n + take, at + take
                    if n == rows:
                        yield out(held)
                        held, n, seq = [], 0, seq + 1
        if held:
            yield out(held)

    ddl = "".join(f"`{c}` {types[c]}, " for c in unit) + "chunk long" + "".join(f", `{c}` array<{types[c]}>" for c in rest)
    return ranged(df, unit, axis).mapInArrow(pack, ddl)


def offsets(sums: DataFrame, unit: Sequence[str]) -> DataFrame:
    """(unit..., chunk, first, last, total[], tie[]) -> (unit..., chunk, before[], after[], tied[]).

    ``before`` and ``after`` sum the chunks on either side; ``tied`` sums earlier rows at the chunk's first time.
    ``tie`` is a chunk's sum over the rows at its last time. A group holds one small row per chunk of a unit."""
    unit = list(unit)
    types = dict(sums.dtypes)
    run_by_value(__name__)

    def scan(table: pa.Table) -> pa.Table:
        t = table.sort_by("chunk").combine_chunks()
        total, tie = matrix(t["total"].chunk(0)), matrix(t["tie"].chunk(0))
        first, last = t["first"].to_numpy(), t["last"].to_numpy()
        before = np.cumsum(total, axis=0) - total
        after = np.cumsum(total[::-1], axis=0)[::-1] - total
        tied, run, at = np.zeros_like(total), np.zeros(total.shape[1]), None
        for i in range(len(first)):
            if at is not None and first[i] == at:
                tied[i] = run
            run = run + tie[i] if at is not None and first[i] == last[i] == at else tie[i]
            at = last[i]
        return pa.Table.from_arrays([*(t[c] for c in unit), t["chunk"], lists(before), lists(after), lists(tied)],
                                    names=[*unit, "chunk", "before", "after", "tied"])

    def one(table: pa.Table) -> pa.Table:
        return scan(table)

    ddl = "".join(f"`{c}` {types[c]}, " for c in unit) + "chunk long, before array<double>, after array<double>, tied array<double>"
    return sums.groupBy(*unit).applyInArrow(one, ddl)


def running(df: DataFrame, unit: Sequence[str], axis: str, vec: str, out: str, descending: bool = False,
            inclusive: bool = True, rows: int | None = None) -> DataFrame:
    """Running sums of ``vec`` along ``axis`` in each unit, next to the columns of ``df``.

    Rows must be distinct on (unit, axis). Written once to the shared folder as chunks; every task adds the offset of
    its chunk, so no task sees a unit's whole axis."""
    from ..session import saved
    unit = list(unit)
    rest = [c for c in df.columns if c not in unit]
    types = dict(df.dtypes)
    chunks = saved(chunked(df, unit, axis, rows), "axis-chunks")
    run_by_value(__name__)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                v, at = matrix(row.column(vec)[0].values), row.column(axis)[0].values
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c) for c in unit), row.column("chunk"), at.slice(0, 1).cast(pa.float64()), at.slice(len(at) - 1).cast(pa.float64()),
                     lists(v.sum(axis=0)[None]), lists(np.zeros((1, v.shape[1])))], names=[*unit, "chunk", "first", "last", "total", "tie"])

    key = "".join(f"`{c}` {types[c]}, " for c in unit)
    sums = chunks.mapInArrow(totals, key + "chunk long, first double, last double, total array<double>, tie array<double>")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                v = matrix(row.column(vec)[0].values)
                n = len(v)
                if descending:
                    cum = np.cumsum(v[::-1], axis=0)[::-1] + matrix(row.column("after"))
                else:
                    cum = np.cumsum(v, axis=0) + matrix(row.column("before"))
                if not inclusive:
                    cum = cum - v
                again = pa.array(np.zeros(n, np.int64))
                yield pa.RecordBatch.from_arrays([*(row.column(c).take(again) for c in unit), *(row.column(c)[0].values for c in rest), lists(cum)],
                                                 names=[*unit, *rest, out])

    joined = chunks.join(offsets(sums, unit), [*unit, "chunk"])
    ddl = ", ".join(f"`{c}` {types[c]}" for c in [*unit, *rest]) + f", `{out}` array<double>"
    return joined.mapInArrow(finish, ddl)
