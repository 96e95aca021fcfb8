"""Operator 3, byte-level BPE by monoid tree reduction.

Encoding is a reduction over a tree: halves are encoded on their own, and two neighbours are joined by
re-encoding a window around their border that grows until the tokens left outside are provably final. Two
monoids are stacked:

* text blocks -> lists of pattern matches. The pattern looks at most three characters past a match's start
  or one past its end, so matches that end three characters before a block's end are final; the rest is
  matched again together with the right neighbour until a match border of the right block is met.
* bytes of one match -> tokens. A token sequence is the BPE encoding exactly if every adjacent pair encodes
  to itself, so a window is wide enough as soon as the pairs at its two borders are stable.

Decoding concatenates token bytes up the tree. Documents are independent, so the operator is one narrow
pass; matches repeat, so a bounded per-worker table keeps what short matches encode to.

Cases: null or empty text -> no tokens, digests of the empty string; special-token strings are ordinary
text; very long texts and very long matches cost O(n log n); repeated rows give equal rows.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import lean, ship, slices, text_column

BLOCK_CHARS = 1 << 15      # leaf of the text tree
MEMO_BYTES = 32            # only short strings are remembered ...
MEMO_ENTRIES = 100_000     # ... and so many of them, then the table starts anew
PIECE_BYTES = 8 << 20      # matches a worker remembers, in UTF-8 bytes, then it starts anew
PIECE_ENTRIES = 300_000
HEAP_BYTES = 48
LEAF_BYTES = 16            # leaf of the byte tree, encoded by definition
DOCS_AT_ONCE = 256
NO_RANK = 1 << 62
LOOKAHEAD = 3

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


#: Texts without a character from here on may be matched by the standard library's faster engine.
LATIN_END = 0x250
BEYOND_LATIN = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]")


def latin_pattern(pattern: str) -> re.Pattern:
    """The same pattern with its Unicode classes spelt out for the characters below ``LATIN_END``."""
    below = [chr(i) for i in range(LATIN_END)]
    classes = {r"\p{L}": [c for c in below if unicodedata.category(c)[0] == "L"],
               r"\p{N}": [c for c in below if unicodedata.category(c)[0] == "N"],
               r"\s": [c for c in below if regex.fullmatch(r"\s", c)], r"\S": [c for c in below if regex.fullmatch(r"\S", c)]}
    listed = {k: "".join(map(re.escape, v)) for k, v in classes.items()}
    out, inside, i = "", False, 0
    while i < len(pattern):
        name = next((k for k in listed if pattern.startswith(k, i)), None)
        part = pattern[i] if name is None else listed[name] if inside else f"[{listed[name]}]"
        inside = inside != (name is None and part == ("]" if inside else "["))
        out, i = out + part, i + len(name or " ")
    return re.compile(out)


class TreeBPE:
    """Encoder and decoder for a rank file (``base64 rank`` lines) and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find, self.find_latin = ranks, regex.compile(pattern), latin_pattern(pattern)
        self.token = {v: k for k, v in ranks.items()}
        self.token_bytes = _Table([self.token.get(i, b"") for i in range(max(self.token, default=-1) + 1)])
        self.digits = _Table([b"%d " % i for i in range(max(self.token, default=-1) + 1)])
        self.stable: dict[tuple[int, int], bool] = {}
        self.memo: dict[bytes, tuple[int, ...]] = {}
        self._forget()
        pairs = sorted((ranks[k[:i]] << 32 | ranks[k[i:]], r) for k, r in ranks.items()
                       for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks)
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int64)
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> TreeBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    # bytes of one match -> tokens
    def _merge(self, b: bytes) -> tuple[int, ...]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first."""
        if len(b) > HEAP_BYTES:
            return self._merge_long(b)
        get = self.ranks.get
        parts = [b[i:i + 1] for i in range(len(b))]
        ranks = [get(x + y, NO_RANK) for x, y in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], NO_RANK)
        return tuple([self.ranks[p] for p in parts])

    def _merge_long(self, b: bytes) -> tuple[int, ...]:
        """The same by a heap of pairs and a linked list, for windows that had to grow far."""
        n, get = len(b), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(b[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if j <= i or j >= n or end[j] != stop or end[j] <= j:
                continue                        # one of the two has been merged meanwhile
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := get(b[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := get(b[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[b[i:end[i]]])
            i = end[i]
        return tuple(out)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of adjacent pairs, NO_RANK for those that do not merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def _merge_many(self, strings: list[bytes]) -> list[tuple[int, ...]]:
        """The definition for many short strings at once: each round merges one pair in every string that has one."""
        sizes = np.array([len(b) for b in strings], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(strings), np.uint8)]
        owner = np.repeat(np.arange(len(strings)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(ids), NO_RANK, np.int64)     # of the pair that starts here
        same = np.flatnonzero(owner[1:] == owner[:-1])
        rank[same] = self._pairs(ids[same], ids[same + 1])
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            length = np.diff(np.append(first, len(ids)))
            best = np.minimum.reduceat(rank, first)
            over = np.repeat(best == NO_RANK, length)
            if over.any():
                done.append((owner[over], ids[over]))
                ids, owner, rank = ids[~over], owner[~over], rank[~over]
                length, best = length[best != NO_RANK], best[best != NO_RANK]
                if not len(ids):
                    break
                first = np.cumsum(length) - length
            hit = np.flatnonzero(rank == np.repeat(best, length))
            at = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]    # leftmost of each string
            ids[at] = rank[at]                                              # a merged token's id is its rank
            gone = at + 1
            keep = np.ones(len(ids), bool)
            keep[gone] = False
            at = at - np.arange(len(at))
            ids, owner = ids[keep], owner[keep]
            rank = rank[keep]
            for i in (at[at > 0] - 1, at):
                i = i[(i + 1 < len(ids))]
                linked = owner[i] == owner[i + 1]
                rank[i[linked]] = self._pairs(ids[i[linked]], ids[i[linked] + 1])
            last = at[(at + 1 >= len(ids)) | (owner[np.minimum(at + 1, len(ids) - 1)] != owner[at])]
            rank[last] = NO_RANK
        owner, ids = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(strings))).tolist()
        flat = ids[order].tolist()
        return [tuple(flat[lo:hi]) for lo, hi in zip([0, *ends], ends)]

    def _leaves(self, b: bytes) -> list[bytes]:
        if len(b) <= LEAF_BYTES:
            return [b]
        m = len(b) // 2
        return self._leaves(b[:m]) + self._leaves(b[m:])

    def _forget(self) -> None:
        """Start the tables of matches and strings anew (every entry can be made again)."""
        self.memo.clear()
        self.stable.clear()
        self.number: dict[str, int] = {}            # match -> entry; an entry's ids lie in one buffer
        self.flat, self.ends, self.held = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0

    def learn(self, pieces: list[str]) -> None:
        """Encode matches not seen yet: all leaves at once, then the joins of the longer ones."""
        encoded = [p.encode() for p in pieces]
        leaves = list({x for b in encoded if b not in self.ranks for x in self._leaves(b)} - self.ranks.keys() - self.memo.keys())
        if len(self.memo) + len(leaves) > MEMO_ENTRIES:
            self.memo.clear()
            leaves = list({x for b in encoded if b not in self.ranks for x in self._leaves(b)} - self.ranks.keys())
        if leaves:
            self.memo.update(zip(leaves, self._merge_many(leaves)))
        found = [self.encode_bytes(b) for b in encoded]
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))
        self.flat.append(np.array([i for ids in found for i in ids], np.int32))
        self.ends.append(self.ends[-1][-1] + np.cumsum([len(ids) for ids in found], dtype=np.int64))
        self.held += sum(map(len, encoded))

    def _pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """All remembered ids and where each entry's begin and end."""
        if len(self.flat) > 1:
            self.flat, self.ends = [np.concatenate(self.flat)], [np.concatenate(self.ends)]
        return self.flat[0], self.ends[0]

    def _pair_stable(self, a: int, b: int) -> bool:
        ok = self.stable.get((a, b))
        if ok is None:
            if len(self.stable) >= MEMO_ENTRIES:
                self.stable.clear()
            ok = self.stable[a, b] = self._merge(self.token[a] + self.token[b]) == (a, b)
        return ok

    def _join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if self._pair_stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self._window(left[-i:], right[:j])
            grow_left = i < len(left) and not self._pair_stable(left[-i - 1], window[0])
            grow_right = j < len(right) and not self._pair_stable(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[:-i] + window + right[j:]
            i, j = min(len(left), 2 * i) if grow_left else i, min(len(right), 2 * j) if grow_right else j

    def _window(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        b = b"".join(map(self.token.__getitem__, left + right))
        got = self.memo.get(b)
        if got is None:
            got = self._merge(b)
            if len(b) <= MEMO_BYTES:
                self._keep(b, got)
        return got

    def _keep(self, b: bytes, ids: tuple[int, ...]) -> None:
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        self.memo[b] = ids

    def encode_bytes(self, b: bytes) -> tuple[int, ...]:
        """Tokens of one match: halves, then a join."""
        r = self.ranks.get(b)
        if r is not None:
            return (r,)
        got = self.memo.get(b)
        if got is None:
            m = len(b) // 2
            got = (self._merge(b) if len(b) <= LEAF_BYTES else
                   self._join(self.encode_bytes(b[:m]), self.encode_bytes(b[m:])))
            if len(b) <= MEMO_BYTES:
                self._keep(b, got)
        return got

    # text -> matches
    def split(self, text: str) -> list[str]:
        """All matches of the pattern, by halves of the text."""
        if len(text) <= BLOCK_CHARS:
            return (self.find if BEYOND_LATIN.search(text) else self.find_latin).findall(text)
        m = len(text) // 2
        return self._join_matches(self.split(text[:m]), self.split(text[m:]), text, m)

    def _join_matches(self, left: list[str], right: list[str], text: str, cut: int) -> list[str]:
        at, keep = cut, len(left)       # the matches cover the text without gaps
        while keep and at > cut - LOOKAHEAD:
            keep -= 1
            at -= len(left[keep])
        out, j, border = left[:keep], 0, cut
        for m in self.find.finditer(text, at):
            out.append(m[0])
            while border < m.end() and j < len(right):
                border += len(right[j])
                j += 1
            if m.end() == border and m.end() >= cut:
                return out + right[j:]
        return out

    # text -> tokens
    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.encode_bytes(piece.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of the texts."""
        split = [self.split(t) for t in texts]
        distinct = set().union(*split)
        new = distinct - self.number.keys()
        if len(self.number) + len(new) > PIECE_ENTRIES or self.held > PIECE_BYTES:
            self._forget()
            new = distinct
        if new:
            self.learn(list(new))
        flat, ends = self._pieces()
        number = self.number
        entry = np.array([number[p] for s in split for p in s], np.int64)
        sizes = ends[entry + 1] - ends[entry]
        ids = _gather(flat, ends[entry], sizes)
        total = np.concatenate([[0], np.cumsum(sizes)])
        offsets = total[np.concatenate([[0], np.cumsum([len(s) for s in split], dtype=np.int64)])]
        if self.held > PIECE_BYTES:         # one slice of very long matches is not kept
            self._forget()
        return ids, offsets

    def digests(self, texts: list[str]) -> tuple[list[tuple[int, str, str, bool]], np.ndarray, np.ndarray]:
        """Of each text: number of ids, sha256 of the ids, sha256 of what they decode to, whether that is the text;
        the ids of all texts and their offsets."""
        ids, offsets = self.encode_all(texts)
        decimal, at = self.digits.joined(ids)
        decoded, to = self.token_bytes.joined(ids)
        out = []
        for text, lo, hi in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist()):
            back = decoded[to[lo]:to[hi]]
            out.append((hi - lo, hashlib.sha256(decimal[at[lo]:max(at[hi] - 1, at[lo])]).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode()))
        return out, ids, offsets


class _Table:
    """Byte strings by number, laid end to end."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in strings], dtype=np.int64)])

    def joined(self, ids: np.ndarray) -> tuple[bytes, list[int]]:
        """The strings of all ids one after the other, and where each begins."""
        sizes = self.ends[ids + 1] - self.ends[ids]
        return _gather(self.flat, self.ends[ids], sizes).tobytes(), np.concatenate([[0], np.cumsum(sizes)])


def _gather(flat: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges [start, start + size) of an array one after the other."""
    n = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    return flat[np.arange(n) + np.repeat(start - first, sizes)]


_loaded: dict[tuple[str, str], TreeBPE] = {}


def encoder(path: str, pattern: str) -> TreeBPE:
    """One encoder per worker process and rank file."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = TreeBPE.from_file(path, pattern)
    return _loaded[path, pattern]


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens): the token ids of every whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(lo, DOCS_AT_ONCE)
                ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
                                                  pa.array(map(len, ids), pa.int64())], names=["doc_id", "ids", "n_tokens"])
    return text_column(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, ids array<int>, n_tokens long")


def bpe_decode(tokens: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes behind each list of ids; null ids give empty bytes."""
    ship(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file, pattern)
        for batch in batches:
            decoded = [bpe.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decoded, pa.binary())], names=["doc_id", "decoded"])
    return tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].alias("ids")).mapInArrow(
        lean(run), "doc_id long, decoded binary")


def bpe_digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: counts, digests and, if asked for, the ids."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file, pattern)
        for batch in batches:
            for part in slices(batch):
                rows, ids, offsets = bpe.digests(part.column("text").to_pylist())
                n, ids_sha, decoded_sha, same = zip(*rows)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha), pa.array(same)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return text_column(docs, id_col, text_col).mapInArrow(lean(run), schema)
