"""The pipeline: every stage's decisions against the operators, whole rows in between, no rows at all."""
import random
from collections import Counter

import numpy as np

import corpus_pipeline as C
from cohortlab.llm import decontaminate, dedup, secrets, toxicity
from cohortlab.llm.common import saved

from .test_brute_force import _sets

SMALL = "/root/testdata/sf0.001"


def test_run_and_empty(spark, awkward, nothing):
    assert C.run(spark, SMALL).count() > 0
    for frame in (awkward, nothing):
        for name, stage in C.STAGES:
            frame = stage(spark, frame, SMALL)
        frame.collect()


def _edited(r, x, start, n):
    """A copy with ``n`` new words in a row, which change ``n + 4`` shingles."""
    return x[:start] + [f"n{r.random()}" for _ in range(n)] + x[start + n:]


def test_near_duplicates_links_at_080(spark):
    """Pairs of 0.80 to 0.85 similar documents are linked in the stage, those below 0.80 are not."""
    r = random.Random(8)
    rows, similar = [], []
    for family in range(40):
        x = [f"w{r.randrange(5000)}" for _ in range(204)]      # 200 shingles
        y = _edited(r, x, r.randint(10, 150), r.choice((13, 16, 18, 19, 22)))
        rows += [(2 * family, " ".join(x)), (2 * family + 1, " ".join(y))]
    sets = _sets(rows)
    for i in range(0, len(rows), 2):
        a, b = sets[i], sets[i + 1]
        similar.append(100 * len(a & b) / len(a | b))
    assert any(80 <= s < 85 for s in similar) and any(s < 80 for s in similar)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"] for x in C.drop_near_duplicates(spark, docs, SMALL).collect()}
    assert got == {i for i, _ in rows if i % 2 == 0 or similar[i // 2] < 80}


def test_bands_recall_at_080():
    """Measured on drawn sets: a pair at 0.8 shares a band nearly always."""
    r = np.random.default_rng(3)
    missed = 0
    for _ in range(2000):
        keys = r.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b = np.sort(keys[:90]), np.sort(keys[10:])        # 80 of 100 in both
        s = dedup.signatures(np.concatenate([a, b]), np.array([0, 90, 180]), C.NEAR)
        missed += not (s[0] == s[1]).any()
    assert missed <= 3


def _kept_at_080(rows):
    """Brute force of the stage: the smallest id of each component, linked at 0.80."""
    sets = _sets(rows)
    where, both, low = {}, Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            both.update((j, i) for j in where.get(g, []))
            where.setdefault(g, []).append(i)
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return {i for i, c in low.items() if i == c}


def test_stages_at_080(spark):
    """Stage 2 on what stage 1 keeps of the documents, and the stages behind it."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    frames = [docs]
    for name, stage in C.STAGES:
        frames.append(saved(stage(spark, frames[-1], SMALL), "test-stage"))
    _, clean, single, free, masked, last = frames
    ids = lambda f: {r["doc_id"] for r in f.select("doc_id").collect()}
    assert ids(single) == _kept_at_080([(r["doc_id"], r["text"]) for r in clean.collect()])
    hit = {r["doc_id"] for r in decontaminate.contaminated(single, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert hit and ids(free) == ids(single) - hit
    texts = {r["doc_id"]: r["text"] for r in free.collect()}
    assert {r["doc_id"]: r["text"] for r in masked.collect()} == {i: secrets.masked(t, secrets.find(t)) for i, t in texts.items()}
    assert ids(last) == ids(free) and last.filter("not round_trip or size(ids) <> n_tokens").count() == 0


def test_documents_without_an_id(spark, unnamed):
    """Unique ones stay, copies of each other stay once, copies of a document with an id go."""
    got = sorted(r["lang"] for r in C.drop_near_duplicates(spark, unnamed, SMALL).collect())
    bs = [x for x in got if x[0] == "b" and x != "blank"]
    assert len(bs) == 1 and [x for x in got if x not in bs] == sorted(["a7", "blank", "c", "d-5", "empty", "empty", "null", "one"])
    rows = dedup.near_duplicates(unnamed).collect()
    assert all(r["kept"] is not None and r["component_id"] is not None for r in rows)
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == {7: 7, -5: -5}
    assert sum(r["component_id"] == 7 for r in rows) == 3 and sum(r["component_id"] == -5 for r in rows) == 2
    frame = unnamed
    for name, stage in C.STAGES:
        frame = stage(spark, frame, SMALL)
    assert len(frame.collect()) == len(got)


def test_items_without_an_id(spark):
    r = random.Random(4)
    item, other = (" ".join(f"x{r.randrange(3000)}" for _ in range(40)) for _ in range(2))
    docs = spark.createDataFrame([(1, "before " + item + " after"), (2, other), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(None, item)], "item_id long, text string")
    assert [x["doc_id"] for x in decontaminate.drop_contaminated(docs, items).collect()] == [2]
