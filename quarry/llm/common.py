"""Shared pieces: durable lineage cuts, checked broadcasts, byte-level text kernels.

Texts are processed as the UTF-8 buffers Arrow hands over, a few megabytes at
a time, so that splitting into words and hashing them are numpy passes over
bytes instead of Python loops over strings.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 96 << 20


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder that all executors share.

    The folder is the cluster's ``spark.checkpoint.dir``. Only where that is
    unset (single-machine tests) is a temporary folder taken.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc.getConf().get("spark.checkpoint.dir")
        if where is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="quarry-checkpoint-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def release() -> None:
    """Hand what this worker has freed back to the system: idle workers stay for reuse, beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose tasks leave no freed memory behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when ``df`` (already materialised) has at most ``rows`` rows and, written out, ``size`` bytes.

    A larger side is left to a shuffled join.
    """
    n, written = df.limit(rows + 1).agg(F.count("*"), F.sum(F.length(F.to_json(F.struct(*[f"`{c}`" for c in df.columns]))))).first()
    return F.broadcast(df) if n <= rows and (written or 0) <= size else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    name, taken = f"__{stem}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash64(text: str) -> str:
    """SQL for a 64-bit row hash that tells null from empty."""
    return f"xxhash64({text}, {text} IS NULL)"


# --------------------------------------------------------------------------- bytes

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _POW or len(_POW["pow"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("pow", _BASE), ("inv", _BASE_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POW[name] = np.multiply.accumulate(x)
    return _POW["pow"], _POW["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(arr: pa.Array, limit: int = CHUNK_BYTES):
    """Yield ``(first_row, bytes, offsets)`` for runs of rows of about ``limit`` bytes; null counts as empty.

    A text longer than the limit makes a chunk of its own; texts are never split.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr, "").cast(pa.large_string())
    if len(arr) == 0:
        return
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes (ASCII letters and digits, any non-ASCII byte)."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    mask = _WORD[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from prefix sums of a polynomial modulo 2^64."""
    power, inverse = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
