"""Shared by the operators: code shipping, scratch tables, and vectorised scans over Arrow text columns."""
from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SLICE_BYTES = 1 << 20   # text handled at once inside a task: bounds the numpy temporaries, not the result

ARROW_ROWS = 1000        # at most so many documents reach a Python worker at once

_SHIPPED = "_cohortlab_llm_shipped"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application (Spark's own file server).

    Rows here are documents or shingle sets, so Spark's default of 10,000 rows an Arrow batch is lowered.
    """
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if getattr(sc, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="cohortlab-py-"), "cohortlab_code.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.join(os.path.basename(root), os.path.relpath(p, root)))
    sc.addPyFile(out)
    setattr(sc, _SHIPPED, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete the folder behind a frame made by :func:`saved` (through Hadoop, so any shared store works)."""
    sc = df.sparkSession.sparkContext
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def text_column(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with null texts as empty ones; every other column is left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, text: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of whole rows of about ``max_bytes`` of text (a longer row stands alone)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    lo, n = 0, batch.num_rows
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, one row after the other, and the rows' offsets (n + 1)."""
    arr = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    buf = arr.buffers()[2]
    if buf is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(buf, np.uint8)[off[0]:off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values for a seed, odd ones where used as multipliers."""
    with np.errstate(over="ignore"):
        return mix(np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
                   + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Rolling:
    """Substring fingerprints by prefix sums modulo 2**64: one pass, then any span in O(1)."""

    every: list[Rolling] = []       # of this process; their power tables grow with the longest text of a task

    def __init__(self, seed: int):
        Rolling.every.append(self)
        self.table = stream(seed, 256)
        self.base = int(stream(seed + 1, 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def shrink(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, np.uint64(base), np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _reach(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << max(16, int(n + 1).bit_length())
            self.up, self.down = self._powers(self.base, size), self._powers(self.inverse, size)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._reach(n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        self._reach(len(prefix))
        return mix((prefix[hi] - prefix[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


#: ASCII white space that separates words: blank, \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross a row's border."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    first = mask.copy()
    first[1:] &= ~mask[:-1] | border[1:n]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | border[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def row_ranges(starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the range [lo, hi) of the runs that start in it; per run its row."""
    lo = np.searchsorted(starts, offsets[:-1])
    hi = np.searchsorted(starts, offsets[1:])
    return lo, hi, np.repeat(np.arange(len(lo)), hi - lo)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all n consecutive values (those across rows are for the caller to leave out)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    c = stream(77 + n, n) | np.uint64(1)
    out = words[:m] * c[0]
    for j in range(1, n):
        out += words[j:m + j] * c[j]
    return mix(out)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: value occurs more than once; value occurred at a smaller index."""
    again = np.zeros(len(keys), bool)
    later = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = k[1:] == k[:-1]
        later[order[1:]] = same
        again[order[1:]] = same
        again[order[:-1]] |= same
    return again, later


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-byte (or per-run) array in each row's range."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def give_back() -> None:
    """Return to the system what a finished task would leave behind in a reused Python worker."""
    for r in Rolling.every:
        r.shrink()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The function for mapInArrow, leaving a small worker behind at the end of each task."""
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()
    return inner


def filter_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], text_col: str = "text") -> DataFrame:
    """Rows, with all their columns, for which ``keep`` says True on the text column. A narrow pass."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(keep(part.column(text_col)), pa.bool_()))
    return docs.mapInArrow(lean(run), docs.schema)
