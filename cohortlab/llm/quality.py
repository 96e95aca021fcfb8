"""Operator 7, quality rules: repetition coverage by rolling hashes of several n-gram lengths.

Words are fingerprinted with a rolling hash over a slice of whole documents at once; for each n the n-grams
of a document that occur again mark all their words, and the share of word characters so covered is
compared with that n's limit. Lines are treated alike. Everything stays within one document, so the
operator is a single narrow pass without a shuffle.

Cases: null, empty or blank text -> zero counts, ``base_failed`` (fewer than ten words); repeated rows and
ties give equal rows; very long texts are handled whole (alone in their slice); an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE, Rolling, flat, ngrams, per_row, repeated, row_ranges, runs, ship, slices, text_column

#: Largest share of word characters inside duplicated n-grams (published web-corpus filter values).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in lines that repeat an earlier line.
LINE_LIMIT = 0.20

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "dup_line_share double, dup_ngram_shares array<double>, reasons string, base_failed boolean, kept boolean")

_ROLL = Rolling(7001)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _salted(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return keys + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _covered(grams: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside the n-grams that start at ``grams``."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, grams, 1)
    np.add.at(step, grams + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts and shares of each document of a slice."""
    n = len(offsets) - 1
    in_word = ~SPACE[data]
    chars = (data & 0xC0) != 0x80
    starts, ends = runs(in_word, offsets)
    lo, hi, row = row_ranges(starts, offsets)
    bounds = np.append(lo, hi[-1] if n else 0)
    prefix = _ROLL.prefix(data)
    words = _ROLL.spans(prefix, starts, ends)
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum(chars & in_word, out=count[1:])
    length = count[ends] - count[starts]
    out = {"n_words": hi - lo, "word_chars": per_row(chars & in_word, offsets), "n_symbols": per_row(_SYMBOL[data], offsets)}

    line_lo, line_hi = _lines(data, offsets)
    line_row = np.searchsorted(offsets, line_lo, side="right") - 1
    line_chars = count[line_hi] - count[line_lo]
    real = line_chars > 0
    line_lo, line_hi, line_row, line_chars = line_lo[real], line_hi[real], line_row[real], line_chars[real]
    _, later = repeated(_salted(_ROLL.spans(prefix, line_lo, line_hi), line_row))
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=n)
    total = np.maximum(out["word_chars"], 1)
    out["dup_line_share"] = np.bincount(line_row[later], weights=line_chars[later], minlength=n) / total

    room = hi[row] - np.arange(len(words)) if len(words) else np.zeros(0, np.int64)
    candidates = None
    shares = []
    for k in sorted(NGRAM_LIMITS):
        g = ngrams(words, k)
        at = np.flatnonzero(room[:len(g)] >= k)
        if candidates is not None:      # both (k-1)-grams of a repeated k-gram are repeated
            at = at[candidates[at] & candidates[at + 1]]
        again, _ = repeated(_salted(g[at], row[at]))
        candidates = np.zeros(len(words) + 1, bool)
        candidates[at[again]] = True
        cover = _covered(at[again], k, len(words))
        if k == 5:
            out["n_repeat_words"] = per_row(cover, bounds)
        shares.append(per_row(cover * length, bounds) / total)
    out["shares"] = np.stack(shares, 1) if n else np.zeros((0, len(NGRAM_LIMITS)))
    return out


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines of every document that has bytes."""
    feeds = np.flatnonzero(data == 10)
    some = offsets[1:] > offsets[:-1]
    lo = np.sort(np.concatenate([offsets[:-1][some], feeds + 1]))
    hi = np.sort(np.concatenate([feeds, offsets[1:][some]]))
    return np.minimum(lo, hi), hi       # a final feed leaves an empty line


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limits = np.array([NGRAM_LIMITS[k] for k in sorted(NGRAM_LIMITS)])
    for batch in batches:
        for part in slices(batch):
            m = measure(*flat(part.column("text")))
            base_failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
            over = m["shares"] > limits
            line_over = m["dup_line_share"] > LINE_LIMIT
            names = [f"dup_{k}gram" for k in sorted(NGRAM_LIMITS)]
            reasons = [",".join((["base"] if b else []) + (["dup_line"] if x else []) + [s for s, o in zip(names, row) if o])
                       for b, x, row in zip(base_failed, line_over, over)]
            kept = ~base_failed & ~line_over & ~over.any(axis=1)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), *(pa.array(m[c], pa.int64()) for c in
                                         ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                pa.array(m["dup_line_share"], pa.float64()), pa.array(list(m["shares"]), pa.list_(pa.float64())),
                pa.array(reasons, pa.string()), pa.array(base_failed), pa.array(kept)],
                names=[f.split()[0] for f in SCHEMA.split(", ")])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, shares inside duplicated n-grams and lines, reasons, verdict."""
    ship(docs.sparkSession)
    return text_column(docs, id_col, text_col).mapInArrow(_batches, SCHEMA)
