"""Operator 13, exact dedup by a minimal perfect hash over the digests of everything seen before.

History is kept as an index: one row per shard of the digest space, holding the bitmaps of a minimal perfect hash
and, in its slots, the full digest of a text, the locator of the row that stays and how many rows had the text.
A new batch is first grouped by digest (partial aggregation, so a text that fills a third of the rows is one row
per task before the shuffle). Its distinct digests go to their shards, where the hash names one slot each; a digest
is a member only if all its 32 bytes equal the slot's, which is what removes repeats. Digests that are no members
form groups of their own and can be added to the history (:func:`extended`).

The hash of a shard has levels: a level maps the digests left over to twice as many bits, a digest that is alone on
its bit is placed there, the others go on. The slot is the rank of the bit, so n digests have the slots 0 to n - 1.

Rows learn the verdict of their digest without a hot key in a shuffle: texts with more than 1/``hot_parts`` of all
rows are fewer than ``hot_parts``, whatever the data, and are broadcast; rows of all others join on the digest.

Texts are equal when identical after replacing each run of ASCII white space by one blank (leading and trailing runs
too). Cases: null text counts as empty, so empty and null texts are one group, blank ones (" ") another; very long
texts whole; a row that occurs twice is a copy of itself and one of the two stays; of equal texts the smallest doc_id
stays, rows without a doc_id come last; if no row of a group has an id, keep_id is null and one of them stays; no rows
-> none; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, mix, saved, ship

CLASS = "digest binary, n long, id long, row long"
INDEX = "shard int, n_slots int, levels array<binary>, digests binary, ns binary, ids binary, id_null binary, rows binary"


@dataclass(frozen=True)
class Params:
    shard_digests: int = 16384      # distinct digests of one shard, about 1 MB of slots
    hot_parts: int = 10_000         # a text with more than 1/hot_parts of the rows is broadcast


@dataclass(frozen=True)
class History:
    """The index rows and the number of shards the digest space is cut into."""
    rows: DataFrame
    shards: int


# ---- minimal perfect hash of one shard --------------------------------------------------------------------------

def _words(digests: np.ndarray) -> np.ndarray:
    """(n, 32) bytes -> (n, 4) unsigned 64-bit words."""
    return np.ascontiguousarray(digests).view("<u8")


def _bits(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each digest on a level; all four words count, so different digests part sooner or later."""
    with np.errstate(over="ignore"):
        h = np.full(len(words), np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15), np.uint64)
        for j in range(4):
            h = mix(h ^ words[:, j])
    return (h % np.uint64(size)).astype(np.int64)


def build_levels(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bitmaps of the levels and the slot of each of n distinct digests."""
    words, left = _words(digests), np.arange(len(digests))
    levels, slot, used = [], np.zeros(len(digests), np.int64), 0
    while len(left):
        size = 2 * len(left) + 1
        bit = _bits(words[left], len(levels), size)
        alone = np.bincount(bit, minlength=size) == 1
        levels.append(alone)
        placed = alone[bit]
        slot[left[placed]] = used + (np.cumsum(alone) - 1)[bit[placed]]
        used += int(alone.sum())
        left = left[~placed]
    return levels, slot


def find_slots(digests: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot that the hash names for each digest, -1 for none. Non-members may get any slot."""
    words, left = _words(digests), np.arange(len(digests))
    out, used = np.full(len(digests), -1, np.int64), 0
    for k, alone in enumerate(levels):
        bit = _bits(words[left], k, len(alone))
        hit = alone[bit]
        out[left[hit]] = used + (np.cumsum(alone) - 1)[bit[hit]]
        used += int(alone.sum())
        left = left[~hit]
    return out


# ---- Arrow helpers ------------------------------------------------------------------------------------------------

def _digest_bytes(column: pa.ChunkedArray) -> np.ndarray:
    raw = column.combine_chunks().cast(pa.binary(32)) if len(column) else pa.array([], pa.binary(32))
    if isinstance(raw, pa.ChunkedArray):
        raw = pa.concat_arrays(raw.chunks)
    return np.frombuffer(raw.buffers()[1], np.uint8)[raw.offset * 32:(raw.offset + len(raw)) * 32].reshape(-1, 32)


def _longs(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    null = column.is_null().to_numpy().astype(bool)
    return column.fill_null(0).to_numpy().astype(np.int64), null


def _packed(levels: list[np.ndarray]) -> list[bytes]:
    return [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in levels]


def _unpacked(raw: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=int.from_bytes(raw[:8], "little")).astype(bool)


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One shard of distinct digests -> its index row."""
    digests = _digest_bytes(table["digest"])
    levels, slot = build_levels(digests)
    at = np.empty(len(slot), np.int64)
    at[slot] = np.arange(len(slot))
    (n, _), (ids, id_null), (rows, _) = (_longs(table[c]) for c in ("n", "id", "row"))
    cells = [key[0].as_py(), len(slot), _packed(levels), digests[at].tobytes(), n[at].tobytes(), ids[at].tobytes(), id_null[at].tobytes(), rows[at].tobytes()]
    types = [pa.int32(), pa.int32(), pa.list_(pa.binary())] + [pa.binary()] * 5
    return pa.Table.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=[f.split()[0] for f in INDEX.split(", ")])


def _slots(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(r["digests"], np.uint8).reshape(-1, 32), np.frombuffer(r["ns"], np.int64), np.frombuffer(r["ids"], np.int64),
            np.frombuffer(r["id_null"], bool), np.frombuffer(r["rows"], np.int64))


def _lookup(key: tuple[pa.Scalar, ...], batch: pa.Table, index: pa.Table) -> pa.Table:
    """New distinct digests of a shard -> what the byte-checked slot holds, nulls for non-members."""
    digests = _digest_bytes(batch["digest"])
    n, ids, rows, gone = (np.zeros(len(digests), np.int64) for _ in range(4))
    member, id_null = np.zeros(len(digests), bool), np.ones(len(digests), bool)
    if index.num_rows and len(digests):
        r = index.to_pylist()[0]
        held, held_n, held_ids, held_null, held_rows = _slots(r)
        slot = find_slots(digests, [_unpacked(x) for x in r["levels"]])
        at = np.maximum(slot, 0)
        member = (slot >= 0) & (held[at] == digests).all(axis=1)
        n, ids, rows, id_null = held_n[at], held_ids[at], held_rows[at], held_null[at]
    cols = [batch[c].combine_chunks() if len(batch[c].chunks) != 1 else batch[c].chunk(0) for c in ("digest", "n", "id", "row")]
    cols += [pa.array(member), pa.array(n, mask=~member), pa.array(ids, mask=~member | id_null), pa.array(rows, mask=~member)]
    return pa.Table.from_arrays(cols, names=["digest", "n", "id", "row", "member", "old_n", "old_id", "old_row"])


# ---- history ------------------------------------------------------------------------------------------------------

def _shard(shards: int):
    """Leading bits of the digest, dealt over the shards."""
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _winner():
    """The row that stays: smallest id, rows without one last, then the row key."""
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row")))


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, id, row) -> one row per digest: n, and id and row of the one that stays."""
    g = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _winner().alias("w"))
    return g.select("digest", "n", "w.id", "w.row")


def build(classes: DataFrame, shards: int | None = None, params: Params = Params()) -> History:
    """Index of distinct digests (``classes`` as from :func:`grouped`), written to the shared folder."""
    ship(classes.sparkSession)
    shards = shards or max(1, -(-classes.count() // params.shard_digests))
    rows = classes.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_build, INDEX)
    return History(saved(rows, "digest-index"), shards)


def lookup(classes: DataFrame, history: History, params: Params = Params()) -> DataFrame:
    """Adds member, old_n, old_id and old_row to a batch's distinct digests.

    A shard that meets more new digests than ``shard_digests`` is copied, so that a group stays bounded."""
    ship(classes.sparkSession)
    copies = max(1, -(-classes.count() // (history.shards * params.shard_digests)))
    side = F.pmod(F.xxhash64("digest"), F.lit(copies)).cast("int")
    new = classes.withColumn("shard", _shard(history.shards)).withColumn("side", side)
    index = history.rows.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return (new.groupBy("shard", "side").cogroup(index.groupBy("shard", "side"))
            .applyInArrow(_lookup, CLASS + ", member boolean, old_n long, old_id long, old_row long"))


def entries(history: History) -> DataFrame:
    """The slots as rows (digest, n, id, row)."""
    ship(history.rows.sparkSession)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held, n, ids, null, rows = _slots(batch.slice(i, 1).to_pylist()[0])
                digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(held), [None, pa.py_buffer(np.ascontiguousarray(held))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([digests, pa.array(n), pa.array(ids, mask=null), pa.array(rows)], names=["digest", "n", "id", "row"])
    return history.rows.mapInArrow(run, CLASS)


def merged(found: DataFrame) -> DataFrame:
    """Looked-up digests with the counts and the winner of old and new rows together."""
    none = F.lit(None).cast("long")
    new = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))
    old = F.when(F.col("member"), F.struct(F.col("old_id").isNull().alias("no_id"), F.col("old_id").alias("id"), F.col("old_row").alias("row")))
    w = F.least(new, F.coalesce(old, F.struct(F.lit(True).alias("no_id"), none.alias("id"), F.lit((1 << 63) - 1).alias("row"))))
    return found.select("digest", (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"), w.alias("w"), "member").select("digest", "n", "w.id", "w.row", "member")


def extended(history: History, found: DataFrame, params: Params = Params()) -> History:
    """The history after a batch: slots of members updated, non-members added, shards rebuilt."""
    now = merged(found)
    old = entries(history).join(now.filter("member").select("digest"), "digest", "left_anti")
    return build(old.unionByName(now.drop("member")), params=params)


# ---- whole table --------------------------------------------------------------------------------------------------

def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, row): sha256 of each whole normalised text, written once; ``row`` tells equal rows apart."""
    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return saved(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def verdicts(rows: DataFrame, classes: DataFrame, total: int, params: Params = Params()) -> DataFrame:
    """Each row with keep_id, keep_row and group_size of its digest."""
    many = classes.filter("n > 1").select("digest", F.col("n").alias("group_size"), F.col("id").alias("keep_id"), F.col("row").alias("keep_row"))
    limit = total // params.hot_parts
    hot, cold = many.filter(F.col("group_size") > limit), many.filter(F.col("group_size") <= limit)
    # no more than hot_parts digests can each hold more than 1/hot_parts of the rows
    out = rows.join(F.broadcast(hot), "digest", "left").select(*rows.columns, F.struct("group_size", "keep_id", "keep_row").alias("hot"))
    found = out.filter("hot.group_size is not null").select(*rows.columns, "hot.*")
    rest = out.filter("hot.group_size is null").select(*rows.columns).join(cold, "digest", "left")
    single = F.col("group_size").isNull()
    rest = rest.select(*rows.columns, F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                       F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("keep_row", "row").alias("keep_row"))
    return found.unionByName(rest)


def exact_duplicates(docs: DataFrame, is_history, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``; ``is_history`` is a condition on ``id`` that says which rows were there before."""
    rows = digests(docs, id_col, text_col)
    old = saved(grouped(rows.filter(F.coalesce(is_history, F.lit(False)))), "digest-classes")
    new = saved(grouped(rows.filter(~F.coalesce(is_history, F.lit(False)))), "digest-classes")
    history = build(old, params=params)
    found = saved(lookup(new, history, params), "digest-found")
    now = merged(found)
    # digests that only the history has; those of the batch are in ``now``
    untouched = old.filter("n > 1").join(found.filter("member").select("digest"), "digest", "left_anti")
    classes = saved(untouched.unionByName(now.drop("member")).filter("n > 1"), "digest-all")
    total = rows.count()
    for f in (old, new, history.rows, found):
        drop_saved(f)
    out = verdicts(rows, classes, total, params)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
