r"""Operator 6, secret scans: patterns first, structural confirmation of encoded material second.

Base kinds (``assign``, ``access``, ``hex``) are found by pattern. Runs in a base64 or hex alphabet are then
decoded, and only those whose bytes parse as a known structure are added:

* ``jwt``   signed token: three base64url parts, the first a JSON object with a string ``alg``
* ``der``   key encoding: ASN.1 SEQUENCE whose nested lengths fill their parents exactly and which starts like
            PKCS#1, SEC 1 or PKCS#8 (version INTEGER) or holds an algorithm identifier (OID)
* ``ssh``   length-prefixed public-key blob or ``openssh-key-v1`` container whose inner lengths add up
* ``pem``   armour lines around a body that is one of the above, or encrypted as its headers say; line ends may be real
            ones or written ``\n``

Keys wrapped over lines are joined before decoding; of a run that does not parse as a whole, the parts behind ``-``, ``_``,
``/`` and ``+`` are tried.

Cases: null or empty text -> zero counts, empty digests; spans are code points, end exclusive; overlapping
kinds are all reported; texts are scanned whole; repeated rows give equal rows; an empty table gives none.
"""
from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship, text_column

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")        # runs are maximal, so the length may stand in the pattern
HEX = re.compile(r"[0-9a-f]{24,}")
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)")
HEX_ANY = re.compile(r"(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,}")
# line ends inside armour and wrapped keys: real ones, or written as \\n and \\r\\n (JSON, env files)
BREAK = r"(?:\s|\\[nr])"
PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]{{3,40}})-----{BREAK}+((?:[A-Za-z][A-Za-z0-9-]*: ?[^\n\\]*(?:\n|\\r?\\?n)(?:[ \t\r]*))*)"
                 rf"((?:[A-Za-z0-9+/=\s]|\\[nr])+?)-----END \1-----")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{24,}(?:[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/]{4,})+={0,2}")
# how the encodings begin in base64: SEQUENCE with its length, an SSH length prefix, the private container
BEGIN = re.compile(r"(?:(?<=[-_/+])|^)(?=M[A-P]|AAAA|b3BlbnNzaC1rZXktdjE)")
SSH_NAME = re.compile(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{3,40}")
JOINT = re.compile(r"[-_/+]")
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem")
SCHEMA = "doc_id long, kind string, start int, end int, evidence string"


def _der_item(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the DER item at ``at``, or None if it does not fit."""
    if at + 2 > end:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(b[at:at + k], "big"), at + k
        if n < 0x80:                    # DER asks for the shortest form
            return None
    return (tag, at, at + n) if at + n <= end else None


def _der_items(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        item = _der_item(b, at, end)
        if item is None:
            return None
        out.append(item)
        at = item[2]
    return out


def der_key(b: bytes) -> str | None:
    """Name of the key encoding if nested lengths fill the bytes exactly."""
    top = _der_item(b, 0, len(b)) if b[:1] == b"\x30" else None
    if top is None or top[2] != len(b):
        return None
    items = _der_items(b, top[1], top[2])
    if not items or len(items) < 2:
        return None
    tags = [t for t, _, _ in items]
    inner = [_der_items(b, s, e) if t == 0x30 else [] for t, s, e in items]
    if any(x is None for x in inner):
        return None
    if tags[0] == 0x02:
        if len(tags) >= 8 and set(tags) == {0x02}:
            return "pkcs1"
        if tags[1] == 0x04:
            return "sec1"
        if tags[1] == 0x30 and len(tags) > 2 and tags[2] == 0x04 and inner[1] and inner[1][0][0] == 0x06:
            return "pkcs8"
        return None
    if tags[0] == 0x30 and inner[0] and inner[0][0][0] == 0x06 and tags[1] in (0x03, 0x04):
        return "spki" if tags[1] == 0x03 else "pkcs8-encrypted"
    return None


def ssh_blob(b: bytes) -> str | None:
    """Length-prefixed fields that fill the blob, the first naming a key type; or the private container."""
    container = b.startswith(b"openssh-key-v1\0")
    at, fields = (15 if container else 0), []
    while at + 4 <= len(b) and not (container and len(fields) == 3):
        n = int.from_bytes(b[at:at + 4], "big")
        if at + 4 + n > len(b):
            return None
        fields.append(b[at + 4:at + 4 + n])
        at += 4 + n
    if container:
        return "openssh-key-v1" if len(fields) == 3 else None
    if at == len(b) and len(fields) >= 2 and SSH_NAME.fullmatch(fields[0]):
        return fields[0].decode()
    return None


def _unb64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True) if len(s) % 4 != 1 else None
    except (binascii.Error, ValueError):
        return None


def _confirmed(b: bytes | None) -> tuple[str, str] | None:
    if not b:
        return None
    if name := der_key(b):
        return "der", name
    if name := ssh_blob(b):
        return "ssh", name
    return None


def _ssh_end(run: str, start: int, stop: int, seen: set[int]) -> tuple[int, str, str] | None:
    """(end, kind, evidence) of an SSH blob that starts at ``start``: it fills the run or ends at a joint.

    A prefix of the run is a blob if it ends where a field does, so one walk over the fields tries every joint. Two walks
    that meet go on alike: ``seen`` holds the bits where fields end that earlier walks left without a blob behind them."""
    def part(at: int, n: int) -> bytes:
        """Bytes [at, at + n) behind the start, fewer at the end of the run."""
        skip = at % 3
        lo = start + (at - skip) // 3 * 4
        hi = min(stop, lo + -(-(skip + n) // 3) * 4)
        return (_unb64(run[lo:hi - ((hi - lo) % 4 == 1)]) or b"")[skip:skip + n]

    size = (stop - start) * 3 // 4
    if part(0, 15) == b"openssh-key-v1\0":          # three fields, then anything
        at = 15
        for _ in range(3):
            if at + 4 > size:
                return None
            at += 4 + int.from_bytes(part(at, 4), "big")
        least = start + max(24, -(-at * 4 // 3))
        ends = (end for end in (stop, *(j.start() for j in JOINT.finditer(run, least, stop))) if end >= least and (end - start) % 4 != 1)
        return next(((end, "ssh", "openssh-key-v1") for end in ends), None)
    name = int.from_bytes(part(0, 4), "big")
    if not 6 <= name <= 46 or not SSH_NAME.fullmatch(first := part(4, name)):
        return None
    at, fresh, joint = 4 + name, [], None
    while at + 4 <= size:
        at += 4 + int.from_bytes(part(at, 4), "big")
        bit, end = 6 * start + 8 * at, start - (-at * 4 // 3)
        if at > size or bit in seen:
            break
        fresh.append(bit)
        if end - start >= 24 and end == stop:
            return stop, "ssh", first.decode()
        if joint is None and end - start >= 24 and JOINT.match(run, end, stop):
            joint = end, "ssh", first.decode()
    if joint is None:
        seen.update(fresh)
    return joint


def _inside(run: str) -> list[tuple[int, int, str, str]]:
    """Keys joined to other text by ``-``, ``_``, ``/`` or ``+``: (start, end, kind, evidence) within the run.

    DER says itself where it ends; SSH fields end at any joint or with the run."""
    out, after, seen, stop = [], 0, set(), len(run.rstrip("="))
    for m in BEGIN.finditer(run):
        start = m.start()
        if start < after:       # inside the key before
            continue
        if run[start] == "M":
            head = _unb64(run[start:min(start + 8, stop)])
            if not head or len(head) < 6 or head[0] != 0x30:
                continue
            n = head[1]
            size = 2 + n if n < 0x80 else 2 + (n & 0x7F) + int.from_bytes(head[2:2 + (n & 0x7F)], "big") if n & 0x7F <= 4 else 0
            end = start - (-size * 4 // 3)
            hit = _confirmed(_unb64(run[start:end])) if 24 <= end - start <= stop - start else None
            found = (end, *hit) if hit else None
        else:
            found = _ssh_end(run, start, stop, seen)
        if found:
            out.append((start, *found))
            after = found[0]
    return out


def _armoured(headers: str, body: str) -> str | None:
    """What stands between armour lines: a known structure, or an encrypted one whose headers say so."""
    raw = _unb64(re.sub(BREAK, "", body))
    if hit := _confirmed(raw):
        return hit[1]
    if raw and "ENCRYPTED" in headers and "DEK-Info:" in headers and len(raw) % 8 == 0:
        return "encrypted"
    return None


def _jwt_alg(head: str) -> str | None:
    b = _unb64(head)
    if not b or b[:1] != b"{":
        return None
    try:
        alg = json.loads(b).get("alg")
    except (ValueError, AttributeError, RecursionError):
        return None
    return alg if isinstance(alg, str) else None


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, evidence) of one text, base kinds first."""
    out = [("assign", m.start(), m.end(), "") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), "") for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), "") for m in HEX.finditer(text)]
    if "ey" in text:
        out += [("jwt", m.start(), m.end(), alg) for m in JWT.finditer(text) if (alg := _jwt_alg(m[1]))]
    for m in ENCODED.finditer(text):
        if hit := _confirmed(_unb64(m[0])):
            out.append((hit[0], m.start(), m.end(), hit[1]))
        else:
            out += [(kind, m.start() + s, m.start() + e, name) for s, e, kind, name in _inside(m[0])]
    for m in WRAPPED.finditer(text):
        if hit := _confirmed(_unb64(re.sub(BREAK, "", m[0]))):
            out.append((hit[0], m.start(), m.end(), "lines:" + hit[1]))
    for m in HEX_ANY.finditer(text):
        if hit := _confirmed(bytes.fromhex(m[0])):
            out.append((hit[0], m.start(), m.end(), "hex:" + hit[1]))
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if name := _armoured(m[2], m[3]):
                out.append(("pem", m.start(), m.end(), name))
    return sorted(set(out), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, *hit) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for hit in find(t)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))],
            names=["doc_id", "kind", "start", "end", "evidence"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per finding."""
    ship(docs.sparkSession)
    return text_column(docs, id_col, text_col).mapInArrow(lean(_spans), SCHEMA)


SUMMARY = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_spans string, spans string, text string"


def _summaries(redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                hits = find(t)
                kinds = [h[0] for h in hits]
                spans = [f"{k}:{s}:{e}" for k, s, e, _ in hits]
                rows.append((i, *(kinds.count(k) for k in KINDS[:3]), sum(k in KINDS[3:] for k in kinds),
                             ",".join(s for s, k in zip(spans, kinds) if k in KINDS[:3]), ",".join(spans),
                             masked(t, hits) if redact else None))
            types = [pa.int64()] * 5 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)],
                                             names=[f.split()[0] for f in SUMMARY.split(", ")])
    return run


def masked(text: str, hits: list[tuple[str, int, int, str]]) -> str:
    """The text with each found span replaced by ``[SECRET:kind]`` (the first kind of overlapping spans)."""
    out, at = [], 0
    for kind, s, e, _ in hits:
        if s >= at:
            out += [text[at:s], f"[SECRET:{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def secret_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row per document: counts by base kind, all spans in order, optionally the redacted text."""
    ship(docs.sparkSession)
    return text_column(docs, id_col, text_col).mapInArrow(lean(_summaries(redact)), SUMMARY)


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the secrets in the text replaced (a null text stays null)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t and masked(t, find(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
    return docs.mapInArrow(lean(run), docs.schema)


def secret_digest(docs: DataFrame) -> DataFrame:
    return secret_summary(docs).select("doc_id", "n_assign", "n_access", "n_hex",
                                       F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans", "n_confirmed")
