"""Operator 9, language identification of words in code-switched text by a linear-chain CRF.

A word's emission scores come from affix (first and last one to three characters), character n-gram (two to
four) and lexicon (whole word) features, hashed into one weight table; label transitions are learned with
them. Training maximises the conditional likelihood by forward-backward on sequences cut from labelled texts and
joined across languages, so that switches occur in what it sees. A text's words are labelled by
forward-backward; the posterior marginals, weighted by word length, give the language and its score.

The model is fitted on a bounded sample of ``sample_rows`` labelled rows; prediction is one narrow pass over
whole texts. The weights (``2**hash_bits`` x languages floats) go to the executors with the function.

Cases: null text or no letter -> ``und`` with score 0; labels that are null are left out of training; without
labelled rows every text is ``und``; with one language that one is predicted; ties go to the first label in order;
repeated rows give equal rows; very long texts whole; no rows -> no rows.
"""
from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, flat, mix, row_ranges, runs, ship, slices, text_column

UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, n_letter_words long, n_switches long, word_share double"
NGRAMS = (2, 3, 4)
_ROLL = Rolling(9001)


@functools.cache
def _classes() -> np.ndarray:
    """Of every code point: 1 letter (category L), 2 mark (M), 0 neither."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c in "LM":
            out[i] = 1 if c == "L" else 2
    return out


def _kinds(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of a UTF-8 buffer belongs to."""
    classes = _classes()
    out = classes[data] * (data < 0x80)
    d = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    for least, end, size, bits in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0xF8, 4, 0x07)):
        at = np.flatnonzero((data >= least) & (data < end))
        point = d[at] & bits
        for k in range(1, size):
            point = point << 6 | d[at + k] & 0x3F
        kind = classes[np.minimum(point, 0x10FFFF)]
        for k in range(size):
            out[at + k] = kind
    return out


@dataclass(frozen=True)
class Params:
    sample_rows: int = 3_000        # labelled rows the model is fitted on, at most about so many
    hash_bits: int = 17
    epochs: int = 3
    piece_words: int = 24           # training sequences are pieces of so many words, several joined
    pieces: int = 3
    rate: float = 0.3
    decay: float = 1e-5


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray             # features x labels
    transitions: np.ndarray         # labels x labels
    hash_bits: int


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, and each row's range of words: letters and marks, a letter at least."""
    data, offsets = flat(pc.utf8_lower(pc.fill_null(column, "")))
    kind = _kinds(data)
    starts, ends = runs(kind > 0, offsets)
    letters = np.concatenate([[0], np.cumsum(kind == 1)])
    real = letters[ends] > letters[starts]
    starts, ends = starts[real], ends[real]
    lo, hi, _ = row_ranges(starts, offsets)
    return data, starts, ends, lo, hi


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, word of each) of affixes, n-grams in bytes and the word itself."""
    prefix = _ROLL.prefix(data)
    size, word = ends - starts, np.arange(len(starts))
    out, owner = [_ROLL.spans(prefix, starts, ends) + np.uint64(1)], [word]
    for k in (1, 2, 3):
        some = np.flatnonzero(size >= k)
        out += [_ROLL.spans(prefix, starts[some], starts[some] + k) + np.uint64(10 + k), _ROLL.spans(prefix, ends[some] - k, ends[some]) + np.uint64(20 + k)]
        owner += [some, some]
    for k in NGRAMS:
        count = np.maximum(size - k + 1, 0)
        w = np.repeat(word, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[w]
        out.append(_ROLL.spans(prefix, at, at + k) + np.uint64(30 + k))
        owner.append(w)
    return (mix(np.concatenate(out)) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owner)


def emissions(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scores (words x labels); equal words of a slice are computed once."""
    key = _ROLL.spans(_ROLL.prefix(data), starts, ends)
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    f, owner = features(data, starts[first], ends[first], model.hash_bits)
    w = model.weights[f]
    return np.stack([np.bincount(owner, weights=w[:, k], minlength=len(first)) for k in range(w.shape[1])], 1)[back]


def forward_backward(emit: np.ndarray, lo: np.ndarray, hi: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posterior marginals of all words of many sequences at once; steps run over the positions of the longest."""
    size = hi - lo
    order = np.argsort(-size, kind="stable")
    start, size = lo[order], size[order]
    live = len(size) - np.searchsorted(size[::-1], np.arange(1, int(size.max(initial=0)) + 1))
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    t = np.exp(transitions)
    fwd, bwd = np.empty_like(e), np.empty_like(e)
    a = None
    for i, n in enumerate(live.tolist()):
        at = start[:n] + i
        a = e[at] if a is None else (a[:n] @ t) * e[at]
        a = a / a.sum(axis=1, keepdims=True)
        fwd[at] = a
    b = np.zeros((0, e.shape[1]))
    for i in range(len(live) - 1, -1, -1):
        n = int(live[i])
        at = start[:n] + i
        now = np.ones((n, e.shape[1]))
        if len(b):
            now[:len(b)] = b
        bwd[at] = now
        b = (now * e[at]) @ t.T
        b = b / b.sum(axis=1, keepdims=True)
    post = fwd * bwd
    return post / post.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], p: Params) -> Model:
    """Stochastic gradient of the CRF likelihood on joined pieces (gradients of pairs by forward-backward too)."""
    labels = sorted(set(langs))
    k = len(labels)
    model = Model(labels, np.zeros((1 << p.hash_bits, k)), np.zeros((k, k)), p.hash_bits)
    if k < 2:
        return model
    model.transitions += np.eye(k)
    data, starts, ends, lo, hi = words_of(pa.array(texts, pa.string()))
    if not len(starts):
        return model
    y_text = np.array([labels.index(x) for x in langs])
    rng = np.random.default_rng(9)
    piece_lo = np.concatenate([np.arange(a, b, p.piece_words) for a, b in zip(lo, hi)])
    row = np.searchsorted(hi, piece_lo, side="right")
    piece_hi = np.minimum(piece_lo + p.piece_words, hi[row])
    # as many pieces of each language
    most = int(np.median(np.bincount(y_text[row], minlength=k)))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y_text[row] == c))[:max(1, most)] for c in range(k)])
    grad2, grad2t = np.full(model.weights.shape, 1e-8), np.full((k, k), 1e-8)
    for _ in range(p.epochs):
        order = rng.permutation(chosen)
        for lot in range(0, len(order), 64 * p.pieces):
            some = order[lot:lot + 64 * p.pieces]
            count = piece_hi[some] - piece_lo[some]
            idx = np.repeat(piece_lo[some] - np.cumsum(count) + count, count) + np.arange(count.sum())
            y = np.repeat(y_text[row[some]], count)
            ends_at = np.cumsum(count)
            seq_hi = np.unique(np.append(ends_at[p.pieces - 1::p.pieces], ends_at[-1]))
            seq_lo = np.append(0, seq_hi[:-1])
            f, owner = features(data, starts[idx], ends[idx], p.hash_bits)
            w = model.weights[f]
            emit = np.stack([np.bincount(owner, weights=w[:, c], minlength=len(idx)) for c in range(k)], 1)
            post, pair = _expectations(emit, seq_lo, seq_hi, model.transitions)
            g = -post
            g[np.arange(len(y)), y] += 1
            inner = np.ones(len(y), bool)
            inner[seq_hi - 1] = False
            at = np.flatnonzero(inner)
            gt = np.bincount(y[at] * k + y[at + 1], minlength=k * k).reshape(k, k) - pair
            unique, back = np.unique(f, return_inverse=True)
            gw = np.stack([np.bincount(back, weights=g[owner, c]) for c in range(k)], 1) - p.decay * model.weights[unique]
            grad2[unique] += gw * gw
            model.weights[unique] += p.rate * gw / np.sqrt(grad2[unique])
            grad2t += gt * gt
            model.transitions += p.rate * gt / np.sqrt(grad2t)
    model.weights = model.weights.astype(np.float32)
    return model


def _expectations(emit, lo, hi, transitions) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the words, and expected counts of label pairs over all sequences."""
    post = forward_backward(emit, lo, hi, transitions)
    # p(a at i, b at i+1) = post(a at i) * p(b at i+1 | a at i, rest); the rest enters by the backward ratio
    k = emit.shape[1]
    inner = np.ones(len(emit), bool)
    inner[hi - 1] = False
    at = np.flatnonzero(inner)
    t = np.exp(transitions)
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    fwd = _forward(e, lo, hi, t)
    ahead = post[at + 1] / np.maximum(fwd[at] @ t, 1e-300)       # e * bwd up to the step's constant
    pair = fwd[at][:, :, None] * t[None] * ahead[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return post, pair.sum(axis=0).reshape(k, k)


def _forward(e, lo, hi, t) -> np.ndarray:
    fwd, size = np.empty_like(e), hi - lo
    order = np.argsort(-size, kind="stable")
    start, size = lo[order], size[order]
    a = None
    for i in range(int(size.max(initial=0))):
        n = int((size > i).sum())
        at = start[:n] + i
        a = e[at] if a is None else (a[:n] @ t) * e[at]
        a = a / a.sum(axis=1, keepdims=True)
        fwd[at] = a
    return fwd


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes=4 << 20):
                rows = predict(model, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, t) for v, t in zip(
                    rows, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64())))],
                    names=[f.split()[0] for f in SCHEMA.split(", ")])
    return run


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Label, score, words, switches between neighbouring words' labels, share of words with the text's label."""
    data, starts, ends, lo, hi = words_of(column)
    n, k = len(lo), len(model.labels)
    has = (hi > lo) & (k > 0)
    if not k or not len(starts):
        return [UNKNOWN] * n, np.zeros(n), hi - lo, np.zeros(n, np.int64), np.zeros(n)
    post = forward_backward(emissions(model, data, starts, ends), lo[has], hi[has], model.transitions)
    weight = (ends - starts).astype(float)
    row = np.repeat(np.arange(n), hi - lo)
    mass = np.stack([np.bincount(row, weights=post[:, c] * weight, minlength=n) for c in range(k)], 1)
    mass /= np.maximum(np.bincount(row, weights=weight, minlength=n), 1)[:, None]
    best = mass.argmax(1)
    label = post.argmax(1)
    switch = np.bincount(row[1:][(label[1:] != label[:-1]) & (row[1:] == row[:-1])], minlength=n)
    share = np.bincount(row, weights=label == best[row], minlength=n) / np.maximum(hi - lo, 1)
    return ([model.labels[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, np.clip(mass[np.arange(n), best], 0, 1), 0.0),
            hi - lo, switch, share)


def fit(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Fit on about ``sample_rows`` rows with a label (by a hash of the id), each distinct text once."""
    known = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    n = known.count()
    share = min(1.0, params.sample_rows / n) if n else 0.0
    rows = (known.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 62)) < F.lit(int(share * (1 << 62))))
            .select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
            .distinct().collect())      # about sample_rows rows
    rows = sorted(rows)
    return train([r["text"] for r in rows], [r["label"] for r in rows], params)


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: predicted language and score, and what the words' labels say about switching."""
    ship(docs.sparkSession)
    return text_column(docs, id_col, text_col).mapInArrow(_predict(model), SCHEMA)


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
