"""Operator 1, exact substring dedup with a logarithmic family of sparse suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Sorting every suffix of
100 TB is out of reach, so the arrays are sparse: of the ``window`` grams (``gram = length - window + 1`` bytes)
inside a string of ``length`` bytes the one with the least fingerprint, leftmost on ties, is its anchor. Equal
strings choose the same anchor at the same place, so suffixes are kept at anchors only (about one in
``window / 2`` bytes) and ordered by the fingerprint of their first gram; the strings that chose an anchor start
in one run of positions before it.

1. The family. Documents come in batches. A batch's suffixes are sorted, merge-scanned against every level for
   equal first grams, and become a level of their own; equal-sized levels are merged, so there are
   logarithmically many and each suffix is rewritten as often.
2. Long matches. A run whose whole extent occurs again at another anchor is repeated altogether: this settles
   copies of any number by counting, and one of them stands for all from there on. What is left lies around
   the ends of matches and is refined: the offset from string to anchor is halved into parts of 16, then 1; a
   part lives on while its strings' common core occurs again, and is settled when its extent does. At 1 core
   and extent are the string itself, so the result is exact (fingerprints have 128 bits where they decide).
3. Removal. Runs of repeated strings are joined per document and cut out.

Rows are told apart by a hash of id and text; texts are shuffled only for documents with open places and for
the final cut. Cases: null or empty text and texts under ``length`` bytes lose nothing; a row that occurs
twice is a copy of itself; very long texts whole; overlaps and self-overlapping repeats count; no rows -> none.
"""
from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, drop_saved, flat, mix, saved, ship, slices

PARTS = (16, 1)         # sizes of the offset ranges after the whole window
BATCHES = 4
HOT_PARTS = 1000        # keys with more than 1/HOT_PARTS of the rows are hot
_A, _B = Rolling(1001), Rolling(1002)
SUFFIX = "rid long, pos int, lo int, hi int, core long, e1 long, e2 long"
NODE = "rid long, pos int, lo int, hi int, open boolean, core long, core2 long, e1 long, e2 long"


@dataclass(frozen=True)
class Params:
    length: int = 400
    window: int = 256

    @property
    def gram(self) -> int:
        return self.length - self.window + 1


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(values)
    padded = np.full(-(-n // w) * w, np.iinfo(np.int64).max, np.int64)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - w + 1], before[w - 1:n])


def anchors(prefix: np.ndarray, offsets: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors and, for each, the first and last start of the strings that chose it."""
    n = len(prefix) - 1
    if n < p.length:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n - p.gram + 1)
    packed = ((_A.spans(prefix, at, at + p.gram) >> np.uint64(33)).astype(np.int64) << 32) | at
    chosen = _least(packed, p.window) & 0xFFFFFFFF
    size = np.diff(offsets)
    count = np.maximum(size - p.length + 1, 0)
    start = np.repeat(offsets[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
    chosen = chosen[start]
    first = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1))[:len(start)])
    last = np.append(first[1:], len(start))[:len(first)] - 1
    return chosen[first], start[first], start[last]


def _extents(prefix, prefix2, pos, lo, hi, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """128-bit fingerprint of all bytes of a run of strings and where the anchor stands in them."""
    salt = (pos - lo).astype(np.uint64) << np.uint64(32)
    end = hi + p.length
    return mix(_A.spans(prefix, lo, end) + salt), mix(_B.spans(prefix2, lo, end) + salt)


def _suffixes(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = flat(part.column("text"))
                a, b = _A.prefix(data), _B.prefix(data)
                pos, lo, hi = anchors(a, offsets, p)
                e1, e2 = _extents(a, b, pos, lo, hi, p)
                row = np.searchsorted(offsets, pos, side="right") - 1
                base = offsets[row]
                yield pa.RecordBatch.from_arrays([
                    pa.array(part.column("rid").to_numpy()[row]), *(pa.array((x - base).astype(np.int32)) for x in (pos, lo, hi)),
                    *(pa.array(x.view(np.int64)) for x in (_A.spans(a, pos, pos + p.gram), e1, e2))],
                    names=[f.split()[0] for f in SUFFIX.split(", ")])
    return run


def _nodes(p: Params, part_size: int):
    """Cut the runs of each text's listed anchors at multiples of ``part_size`` of the offset to the anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = flat(part.column("text"))
                listed = part.column("places")
                places = listed.flatten()
                row = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(listed).to_numpy(zero_copy_only=False))
                pos, lo, hi = (places.field(k).to_numpy().astype(np.int64) + offsets[row] for k in ("pos", "lo", "hi"))
                is_open = places.field("open").to_numpy(zero_copy_only=False)
                t0, t1 = (pos - hi) // part_size, (pos - lo) // part_size
                count = t1 - t0 + 1
                i = np.repeat(np.arange(len(pos)), count)
                t = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + t0[i]
                pos, row = pos[i], row[i]
                lo, hi = np.maximum(lo[i], pos - (t + 1) * part_size + 1), np.minimum(hi[i], pos - t * part_size)
                a, b = _A.prefix(data), _B.prefix(data)
                x, y = pos - t * part_size, pos - (t + 1) * part_size + 1 + p.length
                salt = t.astype(np.uint64) << np.uint64(32)
                core, core2 = mix(_A.spans(a, x, y) + salt), mix(_B.spans(b, x, y) + salt)
                e1, e2 = _extents(a, b, pos, lo, hi, p)
                base = offsets[row]
                yield pa.RecordBatch.from_arrays([
                    pa.array(part.column("rid").to_numpy()[row]), *(pa.array((v - base).astype(np.int32)) for v in (pos, lo, hi)),
                    pa.array(is_open[i]), *(pa.array(v.view(np.int64)) for v in (core, core2, e1, e2))],
                    names=[f.split()[0] for f in NODE.split(", ")])
    return run


class SuffixFamily:
    """Levels of sorted first-gram tables (gram, how often), level i holding 2**i batches."""

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}
        self.found: list[DataFrame] = []        # grams of a new batch that an older level holds

    def add(self, suffixes: DataFrame) -> None:
        """Sort a batch, merge-scan it against each level, then merge levels of equal size."""
        run = saved(suffixes.groupBy("core").agg(F.count("*").alias("n")).sortWithinPartitions("core"), "suffix-level")
        for level in self.levels.values():
            self.found.append(saved(run.join(level.hint("merge"), "core", "left_semi").select("core"), "suffix-found"))
        rank = 0
        while rank in self.levels:
            old = self.levels.pop(rank)
            merged = saved(old.union(run).groupBy("core").agg(F.sum("n").alias("n")).sortWithinPartitions("core"), "suffix-level")
            drop_saved(old)
            drop_saved(run)
            run, rank = merged, rank + 1
        self.levels[rank] = run

    def repeated(self) -> DataFrame:
        """Grams at two places or more: met when a batch came in, or counted twice inside a level."""
        frames = [*self.found, *(x.filter("n > 1").select("core") for x in self.levels.values())]
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out.distinct()

    def drop(self) -> None:
        for f in [*self.found, *self.levels.values()]:
            drop_saved(f)


def semi(left: DataFrame, right: DataFrame, on: list[str], n: int, how: str = "left_semi") -> DataFrame:
    """Rows of ``left`` with (or, left_anti, without) their key in ``right``; ``left`` is a written table of n rows.

    Keys with more than 1/HOT_PARTS of the rows are fewer than HOT_PARTS, whatever the data. They are looked up once
    and then told by a list of literals, so that no task of the shuffle gets a frequent gram's rows; the others join."""
    often = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > n // HOT_PARTS).select(*on)
    hot = often.join(right.select(*on).distinct().withColumn("__in", F.lit(True)), on, "left").collect()
    if not hot:
        return left.join(right.select(*on), on, how)

    def among(rows: list) -> Column:
        out = F.lit(bool(rows))
        for c in on if rows else []:
            out = out & F.col(c).isin([r[c] for r in rows])
        return out

    wanted = among([r for r in hot if bool(r["__in"]) == (how == "left_semi")])
    return left.filter(wanted).unionByName(left.filter(~among(hot)).join(right.select(*on), on, how).select(*left.columns))


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps; it acts when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _by_extent(alive: DataFrame, core: list[str]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Runs whose extent occurs again are settled; one of them goes on as a partner for the open ones."""
    extents = saved(alive.groupBy("e1", "e2").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos", "lo", "hi", "open")).alias("one"),
                                                  *(F.first(c).alias(c) for c in core)), "substring-extents")
    twice, total = extents.filter("n > 1"), alive.count()
    settled = semi(alive, twice, ["e1", "e2"], total).filter("open").select("rid", "lo", "hi")
    # an extent that occurs once is a row of the extents; no join is needed to find these
    once = extents.filter("n = 1").select("one.rid", "one.pos", "one.lo", "one.hi", "one.open", *core)
    single = saved(once, "substring-single")
    wanted = single.filter("open").select(*core).distinct()
    partners = twice.select("one.rid", "one.pos", "one.lo", "one.hi", F.lit(False).alias("open"), *core)
    both = saved(single.union(partners), "substring-going")
    settled = saved(settled, "substring-settled")
    drop_saved(extents)
    return settled, semi(both, wanted, core, total).select("rid", "pos", "lo", "hi", "open"), [single, both]


def repeated_runs(src: DataFrame, p: Params = Params()) -> DataFrame:
    """(rid, lo, hi): runs of starts whose strings occur elsewhere. ``src`` has (rid, text)."""
    spark = src.sparkSession
    # 1. the family of suffix tables
    suffixes = saved(src.mapInArrow(_suffixes(p), SUFFIX), "suffixes")
    family = SuffixFamily()
    for b in range(BATCHES):
        family.add(suffixes.filter(F.pmod("rid", F.lit(BATCHES)) == b).select("core"))
    alive = saved(semi(suffixes, family.repeated(), ["core"], suffixes.count()).withColumn("open", F.lit(True)), "substring-alive")
    family.drop()
    drop_saved(suffixes)
    _release(spark)
    # 2. long matches
    settled, going_on, held = _by_extent(alive, ["core"])
    done = [settled]
    for part_size in PARTS:
        places = going_on.groupBy("rid").agg(F.collect_list(F.struct("pos", "lo", "hi", "open")).alias("places"))
        nodes = saved(src.join(places, "rid").mapInArrow(_nodes(p, part_size), NODE), "substring-nodes")
        for f in (alive, *held):
            drop_saved(f)
        _release(spark)
        cores = nodes.groupBy("core", "core2").agg(F.count("*").alias("n"), F.max("open").alias("wanted")).filter("n > 1 and wanted")
        again = semi(nodes, cores, ["core", "core2"], nodes.count())
        if part_size == 1:
            settled = saved(again.filter("open").select("rid", "lo", "hi"), "substring-settled")
        else:
            alive = saved(again, "substring-alive")
            settled, going_on, held = _by_extent(alive, ["core", "core2"])
        done.append(settled)
        drop_saved(nodes)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _cut(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text, lo, hi in zip(part.column("text"), part.column("lo"), part.column("hi")):
                    raw = text.as_buffer().to_pybytes()
                    spans = _joined(lo, hi, p.length)
                    at, kept = 0, []
                    for a, b in spans:
                        kept.append(raw[at:a])
                        at = b
                    left = b"".join([*kept, raw[at:]])
                    rows.append((len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (
                    pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def _joined(lo: pa.ListScalar, hi: pa.ListScalar, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start in [lo, hi]."""
    if not lo.is_valid or not len(lo.values):
        return []
    a, b = lo.values.to_numpy().astype(np.int64), hi.values.to_numpy().astype(np.int64) + length
    order = np.argsort(a)
    a, reach = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
    return list(zip(a[first].tolist(), reach[np.append(first[1:], len(a)) - 1].tolist()))


def remove_repeats(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: bytes, removed bytes and runs, digest and bytes of what is kept."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    runs = repeated_runs(src.select("rid", "text"), params)
    cuts = runs.groupBy("rid").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    return (src.join(cuts, "rid", "left").select("doc_id", "text", "lo", "hi")
            .mapInArrow(_cut(params), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
