"""Operator 11, target-distribution importance resampling.

1. Features are all runs of 1 to 3 words; a feature's bucket is the crc32 of its bytes modulo ``buckets``. The crc of
   a run is joined from the crcs of its words (crc32 is linear over GF(2)), so every word is hashed once and all
   features of a slice of texts are scored as arrays. Each task counts its buckets in one array; the tasks' arrays are
   summed by Spark, for the corpus and for the target texts, over all rows.
2. A bucket's gain is floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))). A document's weight is the sum of the gains of its
   features; its score adds Gumbel noise that depends on the id alone, so the highest scores are a weighted draw
   without replacement.
3. The draw is a distributed quickselect on the composite key (score down, id up, row): random pivot keys from the
   candidates, exact three-way counts around each pivot, and the candidates between the two pivots that enclose the
   k-th key are written for the next round, about 1/``pivots`` of them each time. Once the candidates are no more than
   the pivots, one of the pivots is the k-th key. Nothing but pivots and counts reaches the driver.
4. Winners alone are range-partitioned, sorted and ranked by partition offset plus place; all other rows keep their
   place in the scored table. No join.

Cases: null or empty text has no features and weight 0; a null id is noise of ``42:`` and ranks after all ids at the
same score; very long texts whole; rows that occur twice count twice in S and are both drawn if their score is (the
row key orders them); fewer than ``min_words`` words: scored, never drawn; no rows -> none; no target rows: T = 0.
"""
from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, drop_saved, flat, row_ranges, runs, saved, ship, slices

# words are runs of digits, lower-cased letters and bytes outside ASCII
WORD = np.ones(256, bool)
WORD[0x00:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False
LONG_WORD = 64          # longer words are hashed one by one


@dataclass(frozen=True)
class Params:
    buckets: int = 10_000
    max_run: int = 3
    min_words: int = 20
    share: tuple[int, int] = (5, 100)
    seed: int = 42
    pivots: int = 64


# ---- crc32 of many byte runs ----------------------------------------------------------------------------------

def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def _shift_tables(n_bits: int) -> list[np.ndarray]:
    """For 1, 2, 4 ... zero bytes: the linear map they apply to a crc register, as four byte-indexed tables."""
    one = _CRC[np.arange(256) & 0xFF]
    first = np.zeros((4, 256), np.uint32)
    x = np.arange(256, dtype=np.uint32)
    first[0] = one
    for j in range(1, 4):
        first[j] = x << np.uint32(8 * (j - 1))
    tables = [first]
    for _ in range(n_bits - 1):
        t = tables[-1]
        tables.append(np.stack([_apply(t, row) for row in t]))
    return tables


def _apply(t: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return t[0][crc & 0xFF] ^ t[1][(crc >> np.uint32(8)) & 0xFF] ^ t[2][(crc >> np.uint32(16)) & 0xFF] ^ t[3][crc >> np.uint32(24)]


_CRC = _crc_table()
_SHIFT = _shift_tables(40)


def _shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc registers after as many zero bytes."""
    out, bit = crc, 0
    left = lengths
    while left.any():
        on = (left & 1).astype(bool)
        out = np.where(on, _apply(_SHIFT[bit], out), out)
        left, bit = left >> 1, bit + 1
    return out


def crc_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each span, byte column by byte column."""
    length = end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    long = length > LONG_WORD
    order = np.argsort(np.where(long, 0, -length), kind="stable")   # longest of the short ones first
    order = order[~long[order]]
    alive, step = len(order), 0
    sizes = length[order]
    while alive:
        alive = int(np.searchsorted(-sizes, -step, side="left"))     # those longer than step
        at = order[:alive]
        c = out[at]
        out[at] = (c >> np.uint32(8)) ^ _CRC[(c ^ data[start[at] + step]) & 0xFF]
        step += 1
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(long):
        out[i] = zlib.crc32(data[start[i]:end[i]])
    return out


def _joined(a: np.ndarray, b: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    """crc32 of x + y from those of x and y."""
    return _shifted(a, b_length) ^ b


def feature_buckets(part: pa.RecordBatch, p: Params, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts: bucket and row of every feature, and the words of each row."""
    data, offsets = flat(part.column(text))
    data = LOWER[data]
    start, end = runs(WORD[data], offsets)
    lo, hi, row = row_ranges(start, offsets)
    word, length = crc_words(data, start, end), end - start
    blank = np.full(len(word), zlib.crc32(b" "), np.uint32)
    after = _joined(blank, word, length)            # the word with a blank before it
    buckets, rows, crc = [word % p.buckets], [row], word
    for n in range(2, p.max_run + 1):
        m = len(word) - n + 1
        if m <= 0:
            break
        crc = _joined(crc[:m], after[n - 1:], length[n - 1:] + 1)
        inside = row[:m] == row[n - 1:]
        buckets.append(crc[inside] % p.buckets)
        rows.append(row[:m][inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(rows), hi - lo


# ---- counts, gains, scores ------------------------------------------------------------------------------------

def bucket_counts(texts: DataFrame, p: Params = Params(), text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(feature_buckets(part, p)[0], minlength=p.buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    src = texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = np.zeros(p.buckets, np.int64)
    for r in src.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, floors."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(key: str) -> int:
    """Gumbel noise in thousandths from a text key alone."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, row) of every document, written once."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                bucket, row, n_words = feature_buckets(part, p)
                n = part.num_rows
                weight = np.zeros(n, np.int64)
                np.add.at(weight, row, gain[bucket])
                z = np.array([noise(f"{p.seed}:{'' if i is None else i}") for i in part.column("doc_id").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n_words, np.bincount(row, minlength=n), weight, weight + z))],
                    names=["doc_id", "n_words", "n_features", "weight", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = src.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")
    return saved(out.withColumn("row", F.monotonically_increasing_id()), "selection-scored")


# ---- distributed quickselect ----------------------------------------------------------------------------------

KEY = ("neg", "no_id", "id", "row")


def _keyed(rows: DataFrame) -> DataFrame:
    """The composite key as four columns without nulls, ascending."""
    return rows.select((-F.col("score")).alias("neg"), F.col("doc_id").isNull().cast("int").alias("no_id"),
                       F.coalesce("doc_id", F.lit(0)).alias("id"), "row")


def _key() -> Column:
    return F.struct(*KEY)


def _lit(key: tuple) -> Column:
    return F.struct(*(F.lit(v).cast("int" if c == "no_id" else "long").alias(c) for v, c in zip(key, KEY)))


def kth_key(keys: DataFrame, k: int, p: Params = Params()) -> tuple:
    """The k-th smallest composite key (k from 1) of (neg, no_id, id, row)."""
    candidates, before, level = keys, 0, 0
    while True:
        # random pivots: the least hashes of the candidates; each task sends no more than ``pivots`` of them
        drawn = candidates.orderBy(F.xxhash64(F.lit(level), *KEY), *KEY).limit(p.pivots).collect()
        pivots = sorted({tuple(r[c] for c in KEY) for r in drawn})
        # three-way: how many keys lie at and how many between the pivots
        below = F.size(F.filter(F.array(*map(_lit, pivots)), lambda v: v < _key()))
        place = (below * 2 + F.array_contains(F.array(*map(_lit, pivots)), _key()).cast("int")).alias("place")
        counts = {r["place"]: r["n"] for r in candidates.groupBy(place).agg(F.count(F.lit(1)).alias("n")).collect()}
        low, low_n, high, seen = None, before, None, before
        for j, v in enumerate(pivots):
            less, equal = seen + counts.get(2 * j, 0), counts.get(2 * j + 1, 0)
            seen = less + equal
            if less < k <= less + equal:
                if level:
                    drop_saved(candidates)
                return v
            if less + equal < k:
                low, low_n = v, less + equal
            else:
                high = v
                break
        inside = F.lit(True)
        if low is not None:
            inside = inside & (_key() > _lit(low)) & (F.col("neg") >= low[0])
        if high is not None:
            inside = inside & (_key() < _lit(high)) & (F.col("neg") <= high[0])
        narrowed = saved(candidates.filter(inside), "selection-candidates")
        if level:
            drop_saved(candidates)
        candidates, before, level = narrowed, low_n, level + 1


def ranked(rows: DataFrame, k: int, p: Params = Params()) -> DataFrame:
    """``rows`` of :func:`scored` with rank 1 to k for the k first keys among those with enough words, else null."""
    none = F.lit(None).cast("long")
    if k <= 0:
        return rows.withColumn("rank", none)
    may = F.col("n_words") >= p.min_words
    last = kth_key(_keyed(rows.filter(may)), k, p)
    key = F.struct((-F.col("score")).alias("neg"), F.col("doc_id").isNull().cast("int").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("row"))
    drawn = may & (key <= _lit(last))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    # place within the range partition and the partition's number, both from one generated id
    won = saved(rows.filter(drawn).repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("at", F.monotonically_increasing_id()), "selection-winners")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["n"]) for r in won.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    ends = np.cumsum([n for _, n in sizes])
    offset = F.element_at(F.create_map(*(F.lit(v).cast("long") for (i, n), e in zip(sizes, ends) for v in (i, e - n))), part)
    return rows.filter(~drawn).withColumn("rank", none).unionByName(won.withColumn("rank", offset + place + 1).drop("at"))


def resampled(docs: DataFrame, target: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Every document with n_words, n_features, weight, score and its rank in the draw towards ``target``."""
    gain = gains(bucket_counts(docs, p, text_col), bucket_counts(target, p, target_text))
    rows = scored(docs, gain, p, id_col, text_col)
    eligible = rows.filter(F.col("n_words") >= p.min_words).count()
    return ranked(rows, p.share[0] * eligible // p.share[1], p).drop("row")
