"""Operator 2, benchmark decontamination by CGK embedding and bit-sampling LSH over item-sized windows.

Texts and items are sequences of normalised words (letter and digit runs, lower case). A document is
contaminated by an item of n words if some stretch of it is within ``floor(0.2 * n)`` word edits of the item.

1. Windows. An alignment with so few edits leaves a run of words untouched (pigeonhole) and shares a least
   number of q-grams (q-gram lemma), so only windows that begin where enough shared q-grams point to can
   match; the others are skipped without loss.
2. Embedding. The random walk of Chakraborty, Goldenberg and Koucky reads a window or item: step j outputs
   the current word and a random bit of (repetition, j, word) says whether to advance. Edit distance becomes
   Hamming distance. Each repetition samples a few coordinates; their hash is the LSH bucket. Items and
   windows of one size meet in equal buckets; ``repetitions`` are set for the target recall.
3. Verification. Candidates are confirmed by exact edit distance (bit-parallel, semi-global).

The item index goes to the executors in blocks of bounded size (``block_words``); documents are read once per
block and are not shuffled. Cases: null or empty texts and items without words match nothing; repeated items
and documents give their own rows; ties keep the first place; very long texts whole; empty tables give no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, filter_rows, flat, lean, mix, ngrams, row_ranges, runs, ship, slices, stream, text_column

SCHEMA = "doc_id long, item_id long, distance int, item_words int, similarity double, start_word long, end_word long"
SLICE = 3 << 20
_ROLL = Rolling(2001)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Params:
    """At the largest allowed distance 32 repetitions of 2 samples find over 99 % of the windows (measured in the tests)."""
    similarity: float = 0.8
    repetitions: int = 32
    samples: int = 2
    block_words: int = 4_000_000

    def edits(self, n: int) -> int:
        return int((1 - self.similarity) * n + 1e-9)

    def gram(self, n: int) -> int:
        """Length of a run of words that any match leaves untouched, 4 at most."""
        k = self.edits(n)
        return min(4, -(-(n - k) // (k + 1)))

    def shared(self, n: int) -> int:
        return max(1, n - self.gram(n) + 1 - self.gram(n) * self.edits(n))


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word fingerprints of all rows, and each row's range of them."""
    data, offsets = flat(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends = runs(_word_bytes(data), offsets)
    lo, hi, _ = row_ranges(starts, offsets)
    return _ROLL.spans(_ROLL.prefix(data), starts, ends), lo, hi


def _word_bytes(data: np.ndarray) -> np.ndarray:
    mask = _WORD[data]
    if len(data) > 2:       # general punctuation and Latin-1 signs are no words
        at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
        mask[at] = mask[at + 1] = mask[at + 2] = False
        at = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] >= 0xA0) & (data[1:] <= 0xBF))
        mask[at] = mask[at + 1] = False
    return mask


class Index:
    """The items of one block: q-gram postings and LSH buckets."""

    def __init__(self, ids: list[int], items: list[np.ndarray], p: Params):
        self.p, self.ids, self.items = p, ids, items
        self.size = np.array([len(x) for x in items], np.int64)
        self.edits = np.array([p.edits(n) for n in self.size], np.int64)
        self.shared = np.array([p.shared(n) for n in self.size], np.int64)
        self.longest = int(self.size.max())
        self.grams = {}
        for q in sorted({p.gram(n) for n in self.size}):
            rows = [i for i, n in enumerate(self.size) if p.gram(n) == q]
            keys = [ngrams(items[i], q) for i in rows]
            key = np.concatenate(keys)
            item = np.repeat(rows, [len(k) for k in keys])
            at = np.concatenate([np.arange(len(k)) for k in keys])
            order = np.argsort(key, kind="stable")
            unique, first = np.unique(key[order], return_index=True)
            self.grams[q] = (unique, np.append(first, len(key)), item[order], at[order], _filter(unique))
        # sampled coordinates: the walk passes a window's end after about 2n steps
        draws = stream(23, 2 * self.longest * p.repetitions).reshape(p.repetitions, -1)
        self.sampled = {}
        for n in np.unique(self.size):
            mask = np.zeros((p.repetitions, 2 * self.longest), bool)
            pick = np.argsort(draws[:, :2 * n], axis=1)[:, :p.samples]
            np.put_along_axis(mask, pick, True, axis=1)
            self.sampled[int(n)] = mask
        self.sizes = np.array(sorted(self.sampled))
        self.mask = np.stack([self.sampled[int(n)] for n in self.sizes])
        padded = np.zeros((len(items), self.longest + 1), np.uint64)
        for i, x in enumerate(items):
            padded[i, :len(x)] = x
        bucket = self.buckets(padded, self.size)
        flat_keys = bucket.ravel()
        order = np.argsort(flat_keys, kind="stable")
        self.bucket_keys, self.bucket_items = flat_keys[order], np.tile(np.arange(len(items)), p.repetitions)[order]

    def buckets(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """LSH buckets (repetitions x windows) of zero-padded windows."""
        reps, m = self.p.repetitions, len(x)
        which = np.searchsorted(self.sizes, size)
        at = np.zeros((reps, m), np.int64)
        rep = np.arange(reps, dtype=np.uint64)[:, None]
        acc = mix(rep * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))
        column = np.arange(m)
        for j in range(2 * self.longest):
            cur = np.where(at < size, x[column, np.minimum(at, x.shape[1] - 1)], np.uint64(0))
            take = self.mask[which, :, j].T
            if take.any():
                acc = np.where(take, mix(acc ^ cur), acc)
            step = mix(cur + (rep << np.uint64(32)) + np.uint64((j + 1) * 0xD1342543DE82EF95 % (1 << 64))) >> np.uint64(63)
            at += step.astype(np.int64)
        return acc

    def windows(self, words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, start) of windows that share enough q-grams with an item."""
        out = []
        row_of = np.repeat(np.arange(len(lo)), hi - lo)
        for q, (unique, first, item, at, maybe) in self.grams.items():
            g = ngrams(words, q)
            pos = np.flatnonzero(maybe[(g & np.uint64(len(maybe) - 1)).astype(np.int64)])
            pos = pos[row_of[pos] == row_of[np.minimum(pos + q - 1, len(words) - 1)]] if len(pos) else pos
            if not len(pos):
                continue
            k = np.minimum(np.searchsorted(unique, g[pos]), len(unique) - 1)
            same = unique[k] == g[pos]
            pos, k = pos[same], k[same]
            count = first[k + 1] - first[k]
            post = np.repeat(first[k] - np.cumsum(count) + count, count) + np.arange(count.sum())
            out.append((np.repeat(pos, count) - at[post], row_of[np.repeat(pos, count)], item[post]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        start, row, item = (np.concatenate(x) for x in zip(*out))
        # hits of one alignment point to starts at most `edits` apart
        group = row * len(self.items) + item
        width = len(words) + 4 * self.longest + 8
        key = group * width + start + 2 * self.longest
        order = np.argsort(key)
        key, start, row, item = key[order], start[order], row[order], item[order]
        near = np.searchsorted(key, key + self.edits[item], side="right") - np.searchsorted(key, key - self.edits[item])
        keep = near >= self.shared[item]
        keep[1:] &= key[1:] != key[:-1]
        return row[keep], item[keep], start[keep]

    def search(self, words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, start, end) with the least distance of every matching pair; places within the row."""
        row, item, start = self.windows(words, lo, hi)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for some in range(0, len(row), 4096):
            r, n, s = row[some:some + 4096], self.size[item[some:some + 4096]], start[some:some + 4096]
            s = np.maximum(s, lo[r])
            at = s[:, None] + np.arange(self.longest + 1)
            inside = (at < hi[r][:, None]) & (np.arange(self.longest + 1) < n[:, None])
            x = np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))
            bucket = self.buckets(x, n)
            a = np.searchsorted(self.bucket_keys, bucket, side="left")
            b = np.searchsorted(self.bucket_keys, bucket, side="right")
            pairs = {(int(w), int(i)) for rep, w in zip(*np.nonzero(b > a)) for i in self.bucket_items[a[rep, w]:b[rep, w]]}
            for w, i in pairs:
                doc, k = int(r[w]), int(self.edits[i])
                first = max(int(s[w]) - k, int(lo[doc]))
                stretch = words[first:min(int(s[w]) + int(self.size[i]) + k, int(hi[doc]))]
                d, begin, end = fit_distance(self.items[i], stretch)
                found = (d, first + begin - int(lo[doc]), first + end - int(lo[doc]))
                if d <= k and found < best.get((doc, i), (k + 1, 0, 0)):
                    best[doc, i] = found
        return [(doc, i, d, s, e) for (doc, i), (d, s, e) in sorted(best.items())]


def _filter(keys: np.ndarray) -> np.ndarray:
    """Which low bits occur: a first look that rules out nearly all positions."""
    table = np.zeros(1 << max(20, int(len(keys) * 16).bit_length()), bool)
    table[(keys & np.uint64(len(table) - 1)).astype(np.int64)] = True
    return table


def _ends(pattern: np.ndarray, text: np.ndarray) -> list[int]:
    """Myers: least edits of the pattern to a stretch of the text that ends at each place (0 .. len(text))."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, [m]
    for w in text.tolist():
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        out.append(score)
    return out


def fit_distance(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(least edits, begin, end) of the pattern against any stretch of the text."""
    scores = _ends(pattern, text)
    d = min(scores)
    end = scores.index(d)
    back = _ends(pattern[::-1], text[:end][::-1])
    return d, end - back.index(min(back)), end


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                words, lo, hi = words_of(part.column("text"))
                found = index.search(words, lo, hi) if len(words) else []
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[r], index.ids[i], d, len(index.items[i]), 1 - d / len(index.items[i]), s, e) for r, i, d, s, e in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (
                    pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()))],
                    names=[f.split()[0] for f in SCHEMA.split(", ")])
    return run


def indexes(benchmark: DataFrame, params: Params, item_col: str, item_text: str, unnamed: bool = False) -> Iterator[Index]:
    """The items in blocks of about ``block_words`` words, each small enough for the driver and a task.

    Items without an id are left out unless ``unnamed``: a pair could not say which item it is about.
    """
    items = text_column(benchmark, item_col, item_text).filter("text <> ''")
    if not unnamed:
        items = items.filter("doc_id is not null")
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-size // params.block_words))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == b).orderBy("doc_id", "text").collect()
        words, lo, hi = words_of(pa.array([r["text"] for r in rows], pa.string()))
        some = [(r["doc_id"], words[x:y]) for r, x, y in zip(rows, lo, hi) if y > x]
        if some:
            yield Index([i for i, _ in some], [w for _, w in some], params)


def contaminated(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document, item) that match: least distance, similarity and place in words."""
    spark = docs.sparkSession
    ship(spark)
    src = text_column(docs, id_col, text_col)
    out = spark.createDataFrame([], SCHEMA)
    for index in indexes(benchmark, params, item_col, item_text):
        out = out.union(src.mapInArrow(lean(_search(index)), SCHEMA))
    return out


def _free(index: Index, column: pa.Array) -> np.ndarray:
    words, lo, hi = words_of(column)
    keep = np.ones(len(column), bool)
    if len(words):
        keep[[r for r, *_ in index.search(words, lo, hi)]] = False
    return keep


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no item, with an id or without."""
    for index in indexes(benchmark, params, item_col, item_text, unnamed=True):
        docs = filter_rows(docs, partial(_free, index), text_col)
    return docs
