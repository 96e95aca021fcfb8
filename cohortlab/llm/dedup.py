"""Operator 4, near-duplicate removal by min-max hashing.

Every permutation gives two signature values, the smallest and the largest hash of a document's shingles, so
half the hash evaluations fill a signature. Bands of three values from different permutations are looked up;
links are confirmed on the full shingle sets; connected components name the smallest doc_id.

The plan keeps hot groups small at every step:

* documents with equal shingle sets are one class (grouped by a 128-bit digest with map-side combining) and
  go on as their smallest doc_id;
* inside a band bucket each member is first compared with the bucket's hub only, the member whose buckets
  are the fullest, so a family of edited copies of one text is tied together by as many links as it has members;
* what stays apart in a bucket goes through prefix filtering: a pair as similar as asked shares one of the
  rarest ``n - ceil(0.85 n) + 1`` shingles of either set, so only members of different components that share
  a bucket and such a shingle are compared. The filter is exact and no link is lost, and edited copies that
  are too far from each other, however many, meet in no rare shingle.

Cases: null, empty or blank text -> empty set, its own component; fewer words than a shingle -> the whole
sequence is the one shingle; repeated rows of one doc_id count once; very long texts whole; no rows -> no rows.
Documents without a doc_id are keyed by a 64-bit fingerprint of their text, so equal texts without an id count
once. A document with an id stays before one without; where no document of a class or component has an id,
``class_id`` and ``component_id`` hold the smallest such key.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Rolling, flat, lean, mix, ngrams, row_ranges, runs, saved, ship, slices, stream


@dataclass(frozen=True)
class Params:
    """39 of 40 values in 13 bands of 3: a pair at similarity 0.85 is missed with probability 4e-6."""
    words: int = 5
    numerator: int = 85         # linked if 100 * intersection >= numerator * union
    permutations: int = 20
    rows_per_band: int = 3
    bands: int = 13


SIGNATURE = "doc_id long, named boolean, n_shingles long, digest binary, bands array<long>"
SETS = "doc_id long, shingles array<long>"
_ROLL = Rolling(4001)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of all documents of a slice, and the documents' offsets in them."""
    data = LOWER[data]
    starts, ends = runs(~SPACE[data], offsets)
    lo, hi, row = row_ranges(starts, offsets)
    words = _ROLL.spans(_ROLL.prefix(data), starts, ends)
    g = ngrams(words, n)
    at = np.flatnonzero(hi[row[:len(g)]] - np.arange(len(g)) >= n)
    keys, rows = [g[at]], [row[at]]
    short = np.flatnonzero((hi > lo) & (hi - lo < n))
    if len(short):
        keys.append(np.array([_whole(words[lo[i]:hi[i]]) for i in short], np.uint64))
        rows.append(short)
    keys, rows = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    first = np.append(True, (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1]))[:len(keys)]
    keys, rows = keys[first], rows[first]
    return keys, np.append(0, np.cumsum(np.bincount(rows, minlength=len(offsets) - 1)))


def _whole(words: np.ndarray) -> np.uint64:
    return mix(ngrams(words, len(words)) + np.uint64(len(words)))[0]


def signatures(keys: np.ndarray, at: np.ndarray, p: Params) -> np.ndarray:
    """Band values (documents x bands) from the minimum and maximum under each permutation."""
    n = len(at) - 1
    some = np.flatnonzero(at[1:] > at[:-1])
    mul, add = stream(41, p.permutations) | np.uint64(1), stream(42, p.permutations)
    values = np.zeros((n, 2 * p.permutations), np.uint64)
    if len(some):
        for j in range(p.permutations):
            h = keys * mul[j]
            h ^= h >> np.uint64(29)
            h *= add[j] | np.uint64(1)
            values[some, j] = np.minimum.reduceat(h, at[some])
            values[some, p.permutations + (j + p.permutations // 2) % p.permutations] = np.maximum.reduceat(h, at[some])
    out = np.zeros((n, p.bands), np.uint64)
    c = stream(43, p.rows_per_band) | np.uint64(1)
    for b in range(p.bands):    # columns b, b + bands, ...: never both ends of one permutation
        acc = np.full(n, (b + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        for r in range(p.rows_per_band):
            acc = mix(acc + values[:, b + r * p.bands] * c[r])
        out[:, b] = acc
    return out


def _signature_batches(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, at = shingle_sets(*flat(part.column("text")), p.words)
                bands = signatures(keys, at, p).astype(np.int64)
                raw, off = keys.astype("<u8").tobytes(), (8 * at).tolist()
                digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(off, off[1:])]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * p.bands), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("named"), pa.array(np.diff(at), pa.int64()), pa.array(digest, pa.binary()), lists],
                                                 names=["doc_id", "named", "n_shingles", "digest", "bands"])
    return run


def _set_batches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, at = shingle_sets(*flat(part.column("text")), n)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "shingles"])
    return run


def _linked(numerator: int):
    """Keep the pairs whose full sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                a, b = (s.values.to_numpy().view(np.uint64) for s in (x, y))     # both sorted
                at = np.searchsorted(a, b)
                both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                ok.append(100 * both >= numerator * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def confirm(pairs: DataFrame, sets: DataFrame, numerator: int) -> DataFrame:
    """(a, b) pairs -> those linked on full sets. The larger side joins last, next to the sets of the hubs."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(lean(_linked(numerator)), "a long, b long")


def components(links: DataFrame, name: str = "component", rounds: int = 60) -> DataFrame:
    """(id, component): smallest id reachable, by alternating large-star and small-star steps.

    Each step keeps the components and shortens the paths; a round costs a few shuffles of the links, and
    the number of rounds grows with the logarithm of the longest path.
    """
    edges = saved(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct(), name)
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(least, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v"))
                 .filter("u < v").distinct())
        edges = saved(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).groupBy("id").agg(F.min("component").alias("component"))
        before = now
    raise RuntimeError("components did not settle")


def _labelled(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """Bucket members with the component found so far."""
    if links is None:
        return members.withColumn("component", F.col("doc_id"))
    c = components(links)
    return (members.join(c.withColumnRenamed("id", "doc_id"), "doc_id", "left")
            .withColumn("component", F.coalesce("component", "doc_id")))


def _rare_shingles(docs: DataFrame, sets: DataFrame, numerator: int) -> DataFrame:
    """(shingle, how many rarer ones, doc_id, ...): the rarest shingles that a link must touch, without those of one document."""
    said = sets.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("shingle"))
    often = said.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = said.join(often, "shingle").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("r"))
    size = F.size("r")
    prefix = F.slice("r", F.lit(1), (size - F.ceil(size * numerator / 100) + 1).cast("int"))
    placed = F.filter(F.transform(prefix, lambda v, i: F.struct(v["n"].alias("n"), v["shingle"].alias("shingle"), i.alias("before"))),
                      lambda v: v["n"] > 1)
    return (ranked.select("doc_id", F.explode(placed).alias("v"))
            .select("doc_id", F.col("v.shingle").alias("shingle"), F.col("v.before").alias("before")).join(docs, "doc_id"))


def _key(id_col: str, text_col: str) -> Column:
    """The doc_id, or for documents without one a key made of the text."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit("no doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def _labels_by_id(comp: DataFrame, classes: DataFrame) -> DataFrame:
    """Components that a key made of a text names take their smallest doc_id as the name, if they have one."""
    unnamed = classes.filter("real is null").select(F.col("rep").alias("key"))
    touched = comp.join(unnamed, F.col("component") == F.col("key"), "left_semi")
    names = (touched.join(unnamed, F.col("id") == F.col("key"), "left_anti")
             .groupBy("component").agg(F.min("id").alias("name")))
    renamed = comp.join(names, "component", "left").select("id", F.coalesce("name", "component").alias("component"))
    return renamed.union(names.select(F.col("component").alias("id"), F.col("name").alias("component")))     # the name given up has no row of its own


def near_duplicates(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: set size, class representative, component and whether the document stays."""
    return _verdicts(docs, params, id_col, text_col).select(
        F.when(F.col("named"), F.col("key")).alias("doc_id"), "n_shingles", "class_id", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that stay. Rows of one doc_id share its verdict; of equal texts without an id one stays."""
    kept = saved(_verdicts(docs, params, id_col, text_col).filter("kept").select(F.col("key").alias("_kept"), "named", "n_shingles"), "kept")
    named = docs.filter(F.col(id_col).isNotNull()).join(kept.filter("named").select("_kept"), F.col(id_col).cast("long") == F.col("_kept"), "left_semi")
    bare = docs.filter(F.col(id_col).isNull()).withColumn("_key", _key(id_col, text_col))
    blank, said = (kept.filter(f"not named and n_shingles {x} 0").select("_kept") for x in ("=", ">"))
    return (named.union(bare.join(blank, F.col("_key") == F.col("_kept"), "left_semi").drop("_key"))
            .union(bare.join(said, F.col("_key") == F.col("_kept"), "left_semi").dropDuplicates(["_key"]).drop("_key")))


def _verdicts(docs: DataFrame, params: Params, id_col: str, text_col: str) -> DataFrame:
    """(key, named, n_shingles, class_id, component_id, kept) of each doc_id and each text without one."""
    ship(docs.sparkSession)
    src = docs.select(_key(id_col, text_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                      F.col(id_col).cast("long").isNotNull().alias("named"))
    sig = saved(src.mapInArrow(lean(_signature_batches(params)), SIGNATURE), "minmax")
    classes = (sig.filter("n_shingles > 0").groupBy("digest", "n_shingles")
               .agg(F.min(F.when(F.col("named"), F.col("doc_id"))).alias("real"), F.min("doc_id").alias("low"), F.min_by("bands", "doc_id").alias("bands"))
               .withColumn("rep", F.coalesce("real", "low")))
    posted = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "bands", F.posexplode("bands").alias("band", "value"))
    sizes = posted.groupBy("band", "value").agg(F.count("*").alias("size")).filter("size > 1")
    members = saved(posted.join(sizes, ["band", "value"]), "buckets")

    # hub of a bucket: the member with the most neighbours over all its buckets
    rank = members.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    hubs = (members.join(rank, "doc_id").groupBy("band", "value")
            .agg(F.max_by("doc_id", F.struct("degree", -F.col("doc_id"))).alias("hub")))
    spokes = (members.join(hubs, ["band", "value"]).filter("doc_id <> hub")
              .select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct())
    sets = saved(src.join(members.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
                 .mapInArrow(lean(_set_batches(params.words)), SETS), "sets")
    links = saved(confirm(spokes, sets, params.numerator), "links")

    # the rest: members of mixed buckets that share a rare shingle across components
    members = _labelled(members, links)
    mixed = (members.groupBy("band", "value").agg(F.min("component").alias("x"), F.max("component").alias("y"))
             .filter("x < y").select("band", "value"))
    apart = members.join(mixed, ["band", "value"], "left_semi").groupBy("doc_id").agg(
        *[F.first(c).alias(c) for c in ("n_shingles", "bands", "component")])
    rare = saved(_rare_shingles(apart, sets, params.numerator), "rare-shingles")
    x, y = rare.alias("x"), rare.alias("y")
    # the first shared shingle leaves room for the overlap that a link needs
    least = params.numerator * (F.col("x.n_shingles") + F.col("y.n_shingles"))
    room = [(100 + params.numerator) * (F.col(f"{t}.n_shingles") - F.col(f"{t}.before")) >= least for t in "xy"]
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.doc_id") < F.col("y.doc_id"))
                   & (F.col("x.component") != F.col("y.component")) & room[0] & room[1]
                   & (100 * F.least("x.n_shingles", "y.n_shingles") >= params.numerator * F.greatest("x.n_shingles", "y.n_shingles"))
                   & F.exists(F.zip_with("x.bands", "y.bands", lambda s, t: s == t), lambda v: v))
    rest = confirm(pairs.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct(), sets, params.numerator)
    comp = _labels_by_id(components(saved(links.union(rest), "links")), classes)

    rows = sig.dropDuplicates(["doc_id"]).join(classes.select("digest", "n_shingles", "rep"), ["digest", "n_shingles"], "left")
    out = rows.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select(
        F.col("doc_id").alias("key"), "named", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("key") == F.col("component_id"))
