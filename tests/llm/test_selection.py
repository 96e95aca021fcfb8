"""Operator 11 against its definition in Python: features, gains, draw, ties, repeated rows, awkward tables."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortlab.llm import selection

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = "/root/testdata/sf0.001"


def _features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), Counter(zlib.crc32(" ".join(w[j:j + n]).encode()) % 10000 for n in (1, 2, 3) for j in range(len(w) - n + 1))


def _expected(rows, target):
    docs = [(i, *_features(t)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in docs:
        s.update(f)
    for x in target:
        t.update(_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for i, n, f in docs:
        weight = sum(c * gain(b) for b, c in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def _got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_against_definition(spark, awkward):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(awkward.columns)
    docs = docs.union(awkward.selectExpr("doc_id + 100000 AS doc_id", *awkward.columns[1:]))
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = _expected(rows, [r["text"] for r in items.collect()])
    assert any(r[4] for r in want)
    assert _got(selection.resampled(docs, items)) == want


def test_crc_of_long_and_odd_words():
    r = random.Random(1)
    words = ["".join(r.choice("ab9é語") for _ in range(n)).encode() for n in (1, 2, 63, 64, 65, 300, 70_000)]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    crc = selection.crc_words(data, end - [len(w) for w in words], end)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    a, b = crc[:-1], crc[1:]
    joined = selection._joined(a, b, np.array([len(w) for w in words[1:]]))
    assert joined.tolist() == [zlib.crc32(x + y) for x, y in zip(words, words[1:])]


@pytest.mark.parametrize("pivots", [1, 3, 64])
def test_quickselect_with_ties_and_repeats(spark, pivots):
    """One score holds a third of the rows; ids repeat and may be null."""
    r = random.Random(pivots)
    rows = [(r.choice([None, *range(40)]), 20, 1, 0, 7 if i % 3 == 0 else r.randrange(5, 10), i) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long, row long")
    keys = sorted((-x[4], int(x[0] is None), x[0] or 0, x[5]) for x in rows)
    p = selection.Params(pivots=pivots)
    for k in (1, 67, 199, 200):
        assert selection.kth_key(selection._keyed(frame), k, p) == keys[k - 1]
    got = {x["row"]: x["rank"] for x in selection.ranked(frame, 90, p).collect()}
    place = {key[3]: i + 1 for i, key in enumerate(keys)}
    assert got == {i: place[i] if place[i] <= 90 else None for i in range(200)}


def test_awkward_tables(spark, awkward, clashing, nothing, unnamed):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert _got(selection.resampled(awkward, none)) == _expected(rows, [])
    assert _got(selection.resampled(clashing, none)) == _expected(rows, [])
    assert selection.resampled(nothing, none).collect() == []
    assert _got(selection.resampled(unnamed, unnamed, id_col="doc_id")) == _expected(
        [(r["doc_id"], r["text"]) for r in unnamed.collect()], [r["text"] for r in unnamed.collect()])
