"""Operator 12, periodic runs by the dictionary of basic factors.

For each power of two L the factors of L words get names, those of 2L from pairs of names of L. Occurrences of one
factor that follow each other with the same distance d <= 2L three times form an arithmetic progression and propose
the period d; consecutive starts of a progression propose one run, which is extended to both sides by descending
through the names, and runs found on several levels are merged.

Why nothing is missed: in a run of smallest period q and at least 4q words take L with q <= L < 2q. A factor of
L words cannot come back sooner than after q words (its first q words would be a power), so the run's first factor
is followed by itself after q and after 2q words, all inside the run. Why periods are smallest: if the stretch
around a proposed (i, d) had a period below d, factor i would have come back sooner than after d words.

Names only go on for factors that occur twice in their text, so levels end with the longest repeated factor. Texts
of a slice are named together, with the text as a part of the word, so nothing crosses documents.

Cases: null, empty and blank texts have no words and no runs; very long texts whole; repeated rows get equal results;
no rows -> none; other columns of the input are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


@dataclass(frozen=True)
class Params:
    min_words: int = 6      # a run has at least so many words
    min_periods: int = 4    # and so many periods


def _paired(names: np.ndarray, at: np.ndarray, length: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the factors of 2 * length words that start at ``at`` (those that may occur twice), and these starts.

    All other factors are named by their place: -1 - start."""
    n = len(names)
    out = -1 - np.arange(n, dtype=np.int64)
    at = at[at + 2 * length <= ends[at]]
    at = at[names[at + length] >= 0]
    if not len(at):
        return out, at
    _, name, count = np.unique(names[at] * n + names[at + length], return_inverse=True, return_counts=True)
    twice = count[name] > 1
    out[at[twice]] = name[twice]
    return out, at[twice]


def _progressions(names: np.ndarray, at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) where a factor is followed by itself twice at the same distance <= reach; of consecutive
    starts with one distance the first."""
    order = at[np.argsort(names[at], kind="stable")]
    a, b, c = order[:-2], order[1:-1], order[2:]
    ok = (names[a] == names[c]) & (b - a == c - b) & (b - a <= reach)
    start, d = a[ok], (b - a)[ok]
    order = np.lexsort((start, d))
    start, d = start[order], d[order]
    first = np.append(True, (start[1:] != start[:-1] + 1) | (d[1:] != d[:-1]))[:len(start)]
    return start[first], d[first]


def _extended(levels: list[np.ndarray], start: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the longest stretch around start whose words are equal d words apart."""
    n = len(levels[0])
    right, left = start.copy(), start.copy()        # words [left, right) equal their partners d further on

    def same(names: np.ndarray, x: np.ndarray, step: int) -> np.ndarray:
        inside = (x >= 0) & (x + d + step <= n)
        y = np.where(inside, x, 0)
        return inside & (names[y] == names[np.where(inside, x + d, 0)]) & (d > 0)

    for k in range(len(levels) - 1, -1, -1):
        step, top = 1 << k, k == len(levels) - 1
        while True:
            go = same(levels[k], right, step)
            right = right + step * go
            back = same(levels[k], left - step, step)
            left = left - step * back
            if not top or not (go.any() or back.any()):
                break
    return left, right + d


def find_runs(words: np.ndarray, sizes: np.ndarray, p: Params = Params()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs in texts laid end to end, by start and period.

    ``words`` holds word numbers, ``sizes`` the words of each text."""
    n = len(words)
    if n < p.min_words:
        return (np.zeros(0, np.int64),) * 3
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)[text]
    _, name, count = np.unique(text * (int(words.max()) + 1) + words, return_inverse=True, return_counts=True)
    names = np.where(count[name] > 1, name, -1 - np.arange(n))
    at = np.flatnonzero(names >= 0)
    levels, found, length = [names], [], 1
    while len(at):
        found.append(_progressions(names, at, 2 * length))
        names, at = _paired(names, at, length, ends)
        levels.append(names)
        length *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, d = (np.concatenate(x) for x in zip(*found))
    left, end = _extended(levels, start, d)
    size = end - left
    ok = size >= np.maximum(p.min_words, p.min_periods * d)
    runs = np.unique(np.stack([left[ok], d[ok], size[ok]]), axis=1)     # by start, then period
    return runs[0], runs[2], runs[1]


def _search(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _slice(part, p)
    return run


def _slice(part: pa.RecordBatch, p: Params) -> pa.RecordBatch:
    # bytes.split() parts at exactly \t \n \v \f \r and the blank
    texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in part.column("text").cast(pa.large_binary())]
    sizes = np.array([len(t) for t in texts], np.int64)
    numbers = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    start, length, period = find_runs(numbers, sizes, p)
    first = np.cumsum(sizes) - sizes
    gone = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    keep = np.cumsum(gone)[:-1] == 0
    row = np.searchsorted(first + sizes, start, side="right")
    collapsed = []
    touched = set(row.tolist())
    for i, t in enumerate(texts):
        if i in touched:
            t = [t[j] for j in np.flatnonzero(keep[first[i]:first[i] + sizes[i]])]
        collapsed.append(b" ".join(t))
    per_text = np.searchsorted(row, np.arange(len(texts) + 1))
    runs = pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), pa.StructArray.from_arrays(
        [pa.array(x.astype(np.int64)) for x in (start - first[row], length, period)], names=["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), runs, pa.array(collapsed, pa.binary()).cast(pa.string())],
                                      names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its words, its runs (by start, then period) and the text without the repeats of any run."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(_search(p), RESULT)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) in which a tenth of the documents, chosen by the crc32 of their id, goes periodic from some word
    on. Texts of the others stay as they are; a document without an id is never chosen."""
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      ((h - h % 10) / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w")
    a = F.pmod(F.col("g"), n)
    share = F.lit(3) + F.pmod(F.col("g"), F.lit(8))
    p = F.lit(1) + ((n - a) - F.pmod(n - a, share)) / share
    src = src.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p.cast("long")))
    planted = F.array_join(F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.element_at("w", (F.col("a") + F.pmod(i - F.col("a"), F.col("p")) + 1).cast("int")))), " ")
    return src.select("doc_id", F.when(F.col("p").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """One row per document: how many runs, the one of greatest length / period, and digests of runs and text."""
    def line(r: Column) -> Column:
        return F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))

    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
                       lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
