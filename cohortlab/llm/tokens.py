"""Operator 8, token ids as Parquet: list columns that can be read selectively.

Documents are range-partitioned by id, sorted, tokenised with the ``tokenizers`` library and written by
Spark's own Parquet writer, so file order is id order and a lost executor only repeats its tasks. The ids
are dictionary-encoded, lengths and ids of documents delta-encoded (format version 2), row groups have a
set size, and the page indexes let a reader skip pages by ``doc_id`` or ``n_tokens`` without the id column.

A whole text's ids are the ids of its blank-separated pieces one after the other: this tokenizer's pattern
never matches across white space, and its normaliser maps characters one by one apart from NFC, which never
composes across a blank. So pieces are encoded once per worker and remembered in a bounded table.

Cases: null or empty text -> the end id alone; very long texts whole; ids are unique per document, repeated
ids are ordered by text; an empty table writes an empty file and reads back as no rows.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import LOWER, Rolling, flat, lean, row_ranges, runs, scratch, ship, slices, text_column

CACHE_ENTRIES = 600_000     # pieces a worker remembers, then it starts anew
_KEY, _CHECK = Rolling(8001), Rolling(8002)
ROW_GROUP_BYTES = 32 << 20
WRITE_OPTIONS = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": str(ROW_GROUP_BYTES),
                 "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000",
                 "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false",
                 "parquet.enable.dictionary#n_tokens": "false", "parquet.dictionary.page.size": str(1 << 20)}
TOKENS = "doc_id long, n_tokens long, ids array<int>"
PLACES = ", place long, part int"       # order of rows with one doc_id, written part


class PieceTable:
    """Ids of blank-separated pieces, encoded by the library when first met.

    Pieces are found in the bytes of a slice of texts and told apart by a 128-bit fingerprint; what is known lies in
    arrays (fingerprints, offsets, one buffer of ids), so only new pieces become strings and a slice's ids are one
    gather. Most pieces are a word of letters with punctuation behind it, which the pattern splits there: these are two
    entries. New words are encoded in one call, blank-separated; the tokens that end a word tell where its ids end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[ends] = True
        self.words: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)       # sorted by key
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)           # where a piece's ids lie
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _alone(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<i4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        for lo in range(0, len(words), 2048):
            some = words[lo:lo + 2048]
            flat = np.frombuffer(self._alone([" ".join(some)])[0], "<i4")
            stops = np.flatnonzero(self.ends_word[flat]) + 1
            if len(stops) == len(some) and stops[-1] == len(flat):
                raw, at = flat.tobytes(), (4 * stops).tolist()
                self.words.update(zip(some, [raw[a:b] for a, b in zip([0, *at], at)]))
            else:       # a vocabulary without word ends
                self.words.update(zip(some, self._alone(some)))

    def _remembered_words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-cased words of letters."""
        self._learn_words(words)
        out = [self.words[w] for w in words]
        self.words.clear()
        return out

    def _find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each fingerprint, -1 if unknown; whether another piece has its first 64 bits."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        held, same = self.key[at] == key, self.check[at] == check
        return np.where(held & same, at, -1), held & ~same

    def _add(self, key: np.ndarray, check: np.ndarray, raw: list[bytes]) -> None:
        ids = np.frombuffer(b"".join(raw), "<i4")
        size = np.array([len(r) // 4 for r in raw], np.int64)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(max(len(ids), self.used), np.int32)])
        self.flat[self.used:self.used + len(ids)] = ids
        at = self.used + np.cumsum(size) - size
        self.used += len(ids)
        place = np.searchsorted(self.key, key)
        self.key, self.check, self.at, self.size = (np.insert(a, place, b) for a, b in (
            (self.key, key), (self.check, check), (self.at, at), (self.size, size)))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column one after the other, and the offsets of the texts."""
        data, offsets = flat(column)
        text, start, end, word, first_unit = _units(data, offsets)
        fp = [(roll.spans(roll.prefix(text), start, end) & ~np.uint64(1)) | word.astype(np.uint64)    # a word (lower-cased) is never a raw piece
              for roll in (_KEY, _CHECK)]
        key, first, back = _distinct(fp[0])
        check = fp[1][first]
        if len(self.key) + len(key) > CACHE_ENTRIES:
            self._forget()
        # a key is free unless another piece has the same 64 bits; such pieces are never remembered
        entry, taken = self._find(key, check)
        clash = (fp[1] != check[back]) | taken[back]
        new = np.flatnonzero((entry < 0) & ~taken)
        if len(new):
            at = first[new]
            order = np.argsort(~word[at], kind="stable")        # words, then raw pieces; both in key order
            new, at = new[order], at[order]
            raw = self._ids(text, start[at], end[at], word[at])
            order = np.argsort(key[new])
            self._add(key[new][order], check[new][order], [raw[i] for i in order.tolist()])
            entry, _ = self._find(key, check)
        at, size = self.at[entry][back], self.size[entry][back]
        source = self.flat
        if clash.any():
            i = np.flatnonzero(clash)
            i = i[np.argsort(~word[i], kind="stable")]
            own = self._ids(text, start[i], end[i], word[i])
            size[i] = [len(r) // 4 for r in own]
            at[i] = len(source) + np.cumsum(size[i]) - size[i]
            source = np.concatenate([source, np.frombuffer(b"".join(own), "<i4")])
        total = np.concatenate([[0], np.cumsum(size)])
        ids = source[np.arange(total[-1]) + np.repeat(at - total[:-1], size)]
        return ids, total[first_unit]

    def _ids(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> list[bytes]:
        """Ids of spans; those of words come first."""
        n, raw = int(word.sum()), text.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
        return self._remembered_words(pieces[:n]) + self._alone(pieces[n:])


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and each value's entry (any place will do, so the sort need not be stable)."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], order[new], back


#: Punctuation that the pattern parts from the letters before it.
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?#$%&*")] = True


def _next(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First True at or after each position (the length if there is none)."""
    places = np.append(np.flatnonzero(mask), len(mask))
    return places[np.searchsorted(places, at)]


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blank-separated pieces; those of letters and then punctuation become two units, the letters lower-cased.

    Returns the bytes with words lower-cased, starts and ends of units, which are words, and each text's first unit. Letters
    are those of ASCII and Latin-1; a piece with any other character stays whole and is lower-cased by the library."""
    low = LOWER[data]
    letter = (low >= 97) & (low <= 122)
    if len(data) > 1:
        pair = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        at = np.flatnonzero(pair)
        letter[at] = letter[at + 1] = True
        upper = at[data[at + 1] <= 0x9E] + 1
        low[upper] = data[upper] + 0x20
    start, end = runs((data != 0x20) & (data != 0x0A), offsets)
    _, hi, _ = row_ranges(start, offsets)
    core = np.minimum(_next(~letter, start), end)
    others = np.zeros(len(data) + 1, np.int32)
    np.cumsum(~_TAIL[data], out=others[1:])
    simple = (core > start) & (others[end] == others[core])
    two = simple & (core < end)
    count = 1 + two
    at = np.cumsum(count) - count
    u_start, u_end, word = np.repeat(start, count), np.repeat(end, count), np.zeros(int(count.sum()), bool)
    word[at] = simple
    u_end[at[two]] = core[two]
    u_start[at[two] + 1] = core[two]
    ends = np.append(0, at + count)
    edges = np.zeros(len(data) + 1, np.int8)       # 1 where a word begins, -1 behind it
    edges[start[simple]] += 1
    edges[core[simple]] -= 1
    text = np.where(np.cumsum(edges[:-1], dtype=np.int8).view(bool), low, data)
    return text, u_start, u_end, word, ends[np.append(0, hi)]


_tables: dict[str, PieceTable] = {}


def _table(path: str) -> PieceTable:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def write_tokens(docs: DataFrame, tokenizer_file: str, end_id: int, path: str, id_col: str = "doc_id",
                 text_col: str = "text", partitions: int | None = None) -> None:
    """Tokenise every whole text and write (doc_id, n_tokens, ids, part) in ascending id order."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tokenizer_file)
        for batch in batches:
            for part in slices(batch):
                ids, offsets = table.encode(part.column("text"))
                n = np.diff(offsets)
                ids = np.insert(ids, offsets[1:], end_id)
                out = pa.ListArray.from_arrays(pa.array((offsets + np.arange(len(offsets))).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n + 1), out], names=["doc_id", "n_tokens", "ids"])
    src = text_column(docs, id_col, text_col)
    by = [partitions, "doc_id"] if partitions else ["doc_id"]
    rows = src.repartitionByRange(*by).sortWithinPartitions("doc_id", "text").mapInArrow(lean(run), TOKENS)
    rows.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()).write.options(**WRITE_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS + PLACES).parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """From the files: per document where its ids start in the whole sequence, how many, and their CRC-32.

    Starts are running sums inside each written part plus the totals of the parts before it (one row a part).
    """
    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            off, flat = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(), "<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("place"), pa.array(np.diff(off), pa.int64()),
                                              pa.array(crc, pa.int64())], names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])
    ship(spark)
    rows = read_tokens(spark, path).select("doc_id", "part", "place", "ids").mapInArrow(
        crcs, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    totals = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = W.Window.partitionBy("part").orderBy("doc_id", "place").rowsBetween(W.Window.unboundedPreceding, -1)
    return (rows.withColumn("skip", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .join(F.broadcast(parts), "part")       # one row for each written part
            .select("doc_id", (F.col("base") + F.col("skip")).alias("start"), "n_tokens", "ids_crc32"))


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Write to a new shared folder, then derive the index from what was written."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, tokenizer_file, end_id, path)
    return token_index(spark, path)
