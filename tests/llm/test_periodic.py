"""Operator 12 against the definition of a run, tried for every period."""
import hashlib
import random
import re
import zlib

import numpy as np

from cohortlab.llm import periodic


def _runs(w, least=6, times=4):
    """All runs by definition: per period the maximal stretches, without those of a smaller period."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            s = w[i:j + q]
            if j > i and size >= max(least, times * q) and not any(s[r:] == s[:-r] for r in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _digests(i, w):
    runs = _runs(w)
    gone = {j for s, size, q in runs for j in range(s + q, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(x for j, x in enumerate(w) if j not in gone)))


def _planted(i, w):
    h = zlib.crc32(str(i).encode())
    if i is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]


def test_find_runs_in_drawn_texts():
    r = random.Random(2)
    total = 0
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 5)):
            n, k = r.randint(0, 90), r.choice([1, 2, 3, 8])
            t = [r.randrange(k) for _ in range(n)]
            if n > 10 and r.random() < .7:
                a = r.randrange(n - 5)
                p = r.randint(1, max(1, (n - a) // 4))
                t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
                if r.random() < .4:
                    t[r.randrange(n)] = 9
            texts.append(t)
        want, at = [], 0
        for t in texts:
            want += [(s + at, size, q) for s, size, q in _runs(t)]
            at += len(t)
        got = periodic.find_runs(np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts]))
        assert list(zip(*(x.tolist() for x in got))) == want
        total += len(want)
    assert total > 500


def test_whole_table_with_planted_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], _planted(r["doc_id"], _words(r["text"]))) for r in docs.collect()]
    rows = [(i, w) for i, w in rows if len(w) < 3000]
    found = periodic.run_digests(periodic.periodic_runs(periodic.with_planted_runs(docs)))
    got = {r["doc_id"]: tuple(r) for r in found.collect()}
    want = [_digests(i, w) for i, w in rows]
    assert [got[x[0]] for x in want] == want
    assert sum(x[1] > 0 for x in want) > len(want) // 20


def test_long_periods_and_long_texts(spark):
    r = random.Random(4)
    unit = [f"u{r.randrange(10 ** 6)}" for _ in range(5000)]
    rows = [(1, " ".join(unit * 5)), (2, "x " * 200_000), (3, " ".join(unit)), (4, " ".join(unit * 3))]
    got = {x["doc_id"]: [tuple(y) for y in x["runs"]] for x in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(0, 25_000, 5000)], 2: [(0, 200_000, 1)], 3: [], 4: []}


def test_awkward_tables(awkward, clashing, nothing, unnamed):
    for docs in (awkward, clashing, unnamed):
        found = periodic.run_digests(periodic.periodic_runs(periodic.with_planted_runs(docs)))
        want = [_digests(r["doc_id"], _planted(r["doc_id"], _words(r["text"]))) for r in docs.collect() if len(_words(r["text"])) < 5000]
        got = [tuple(r) for r in found.collect()]
        assert set(want) <= set(got) and len(got) == docs.count()
    assert periodic.run_digests(periodic.periodic_runs(periodic.with_planted_runs(nothing))).collect() == []
