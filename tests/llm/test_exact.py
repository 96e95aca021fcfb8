"""Operator 13 against direct grouping: hash of a shard, history and batches, ties, a hot text, awkward rows."""
import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from cohortlab.llm import exact


def _expected(rows):
    """(doc_id, keep_id, group_size, kept, digest) with one row kept a group."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()].append(i)
    out = []
    for h, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, h) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _half():
    return F.pmod(F.xxhash64("id"), F.lit(2)) == 0


def test_minimal_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        members = r.integers(0, 256, (n, 32), dtype=np.uint8)
        levels, slot = exact.build_levels(members)
        assert sorted(slot) == list(range(n))
        assert (exact.find_slots(members, levels) == slot).all()
        assert all((exact._unpacked(p) == b).all() for p, b in zip(exact._packed(levels), levels))
        strangers = exact.find_slots(r.integers(0, 256, (500, 32), dtype=np.uint8), levels)
        assert (strangers < max(n, 1)).all()        # some slot or none: only the byte check tells


def test_digests_that_share_three_words_still_part():
    d = np.zeros((300, 32), np.uint8)
    d[:, 24] = np.arange(300) % 256
    d[:, 25] = np.arange(300) // 256
    assert sorted(exact.build_levels(d)[1]) == list(range(300))


def test_awkward_rows(awkward, clashing, nothing, unnamed):
    want = _expected([(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert _got(exact.exact_duplicates(awkward, _half())) == want
    assert _got(exact.exact_duplicates(clashing, _half())) == want
    assert _got(exact.exact_duplicates(nothing, _half())) == []
    assert _got(exact.exact_duplicates(unnamed, _half())) == _expected([(r["doc_id"], r["text"]) for r in unnamed.collect()])


def test_any_split_into_history_and_batch(spark):
    """Nothing known, everything known, winners on either side, many small shards, many new digests a shard."""
    rows = [(i, f"text {i % 700}" + " \t" * (i % 3) + "end") for i in range(3000)] + [(-4, "text 5 end"), (None, "text 6 end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p, want = exact.Params(shard_digests=50), _expected(rows)
    for is_history in (F.lit(False), F.lit(True), F.col("id") >= 0, F.col("id") < 0, F.col("id") < 100):
        assert _got(exact.exact_duplicates(docs, is_history, p)) == want


def test_hot_text_is_broadcast_and_whole(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(exact.exact_duplicates(docs, _half(), exact.Params(hot_parts=10))) == _expected(rows)


def test_history_grows_by_batches(spark):
    rows = [(i, f"text {i % 40}") for i in range(300)]
    docs = exact.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    p = exact.Params(shard_digests=8)
    history = exact.build(exact.grouped(docs.filter("id >= 290")), params=p)
    for lo, hi in ((100, 290), (0, 100)):
        history = exact.extended(history, exact.lookup(exact.grouped(docs.filter(f"id >= {lo} and id < {hi}")), history, p), p)
    assert history.shards == 5
    got = sorted(map(tuple, exact.entries(history).collect()))
    assert got == sorted(map(tuple, exact.grouped(docs).collect()))
